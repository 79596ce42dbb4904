"""Shards of near equal bytes by histogram sort (DataFrame operations only).

Rows are ordered by a hash of the text, then a hash of the id.  Splitters are found by counting: each round counts exact
bytes below evenly spaced candidate boundaries inside the intervals that still hold a splitter, until every splitter is
within tolerance.  Boundaries fall between different texts wherever that meets the tolerance, so equal texts share a shard;
only a group of copies too large for that is divided, by id.  Rows are exchanged once, after the splitters are known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import stage

#: Bits that one round of probing refines (4096 candidate boundaries in each open interval).
PROBE_BITS = 12


def _unsigned(h: Column) -> Column:
    """A 63-bit key that is never negative."""
    return F.shiftrightunsigned(h, 1)


def _splitters(keys: DataFrame, shards: int, tolerance: float) -> tuple[list[tuple[int, int]], int]:
    """(key, key2) boundaries: a row is above one if its pair is not smaller.  And the number of rounds.

    ``keys``: key, key2 (63 bits) and size.  Each round is one aggregation, whose result has at most 4096 rows for each open splitter.
    """
    total = keys.agg(F.sum("size")).first()[0] or 0
    slack = tolerance * total / shards
    goals = [total * i / shards for i in range(1, shards)]
    # open intervals: prefix of the pair (126 bits), bits fixed so far, bytes below it
    todo = {i: (0, 0, 0) for i in range(len(goals))}
    done: dict[int, tuple[int, int]] = {}
    rounds = 0
    while todo:
        rounds += 1
        bits = next(iter(todo.values()))[1]
        take = min(PROBE_BITS, (63 if bits < 63 else 126) - bits)
        prefixes = sorted({p for p, _, _ in todo.values()})
        # which part of the pair this round's digit comes from
        column, left = ("key", 63 - bits - take) if bits < 63 else ("key2", 126 - bits - take)
        digit = F.shiftright(F.col(column), left).bitwiseAND(F.lit((1 << take) - 1)).cast("int")
        if bits == 0:
            inside, own = F.lit(True), F.lit(0)
        else:
            own = F.lit(-1)
            for n, p in enumerate(prefixes):
                same = (F.shiftright("key", 63 - bits) == p) if bits <= 63 else ((F.col("key") == p >> (bits - 63)) & (F.shiftright("key2", 126 - bits) == (p & ((1 << (bits - 63)) - 1))))
                own = F.when(same, n).otherwise(own)
            inside = own >= 0
        seen = keys.withColumn("own", own).filter(inside).groupBy("own", digit.alias("digit")).agg(F.sum("size").alias("bytes")).orderBy("own", "digit").collect()
        by: dict[int, list[tuple[int, int]]] = {}
        for r in seen:
            by.setdefault(prefixes[r.own], []).append((r.digit, r.bytes))
        for i, (prefix, _, below) in list(todo.items()):
            at, best, inner = below, None, None
            for d, n in by.get(prefix, []):
                for edge, count in ((d, at), (d + 1, at + n)):
                    if best is None or abs(count - goals[i]) < abs(best[1] - goals[i]):
                        best = (edge, count)
                if at <= goals[i] < at + n or inner is None and at + n >= goals[i]:
                    inner = (d, at)
                at += n
            if best is None or inner is None or abs(best[1] - goals[i]) <= slack or bits + take == 126:
                edge = (prefix << take) + (best[0] if best else 0)
                full = edge << (126 - bits - take)
                done[i] = (full >> 63, full & ((1 << 63) - 1))
                del todo[i]
            else:
                todo[i] = ((prefix << take) + inner[0], bits + take, inner[1])
    return [done[i] for i in sorted(done)], rounds


def shard_by_bytes(docs: DataFrame, shards: int = 8, tolerance: float = 0.001, doc_id: str = "doc_id", text: str = "text", cells: int = 4096, sub: int = 256) -> DataFrame:
    """``docs`` with size, text_crc32, shard and slot added (columns of these names are replaced).

    size: UTF-8 bytes plus 1 (null text: 1); text_crc32: of the UTF-8 bytes (null: 0).  Shards differ from an equal share of
    the bytes by ``tolerance`` of it at each end, or by one row where a row is larger.  slot numbers the rows of a shard
    from 0 without gaps.  Null ids and null texts have hashes of their own; rows that repeat both id and text are not told
    apart and stay in one shard.  An empty table gives an empty result.
    """
    size = (F.coalesce(F.octet_length(docs[text]), F.lit(0)) + 1).cast("long")
    key, key2 = _unsigned(F.xxhash64(docs[text])), _unsigned(F.xxhash64(docs[doc_id], F.lit(1)))
    keys = stage(docs.select(key.alias("key"), key2.alias("key2"), size.alias("size")))
    splitters, _ = _splitters(keys, shards, tolerance)

    def shard_of(k: str | Column, k2: str | Column) -> Column:
        k, k2 = (F.col(x) if isinstance(x, str) else x for x in (k, k2))
        out: Column = F.lit(0)
        for a, b in splitters:
            out = out + F.when((k > a) | ((k == a) & (k2 >= b)), 1).otherwise(0) if a < 1 << 63 else out
        return out.cast("int")

    def cell_of(k: Column, bits: int) -> Column:
        return F.shiftright(k, 63 - bits).cast("int")

    a, b = cells.bit_length() - 1, sub.bit_length() - 1
    own = "__s"  # names that no column has
    while any(c.lower().startswith(own) for c in docs.columns):
        own += "_"
    in_shard, in_cell, in_sub, first, k1, k2 = (own + c for c in "abcdef")
    counts = keys.groupBy(shard_of("key", "key2").alias(in_shard), cell_of(F.col("key"), a).alias(in_cell), cell_of(F.col("key2"), b).alias(in_sub)).count()
    before = F.sum("count").over(Window.partitionBy(in_shard).orderBy(in_cell, in_sub).rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(in_shard, in_cell, in_sub, F.coalesce(before, F.lit(0)).alias(first))
    crc = F.when(docs[text].isNull(), 0).otherwise(F.crc32(docs[text].cast("binary"))).cast("long")
    kept = [docs[c] for c in docs.columns if c not in ("size", "text_crc32", "shard", "slot")]
    names = [c for c in docs.columns if c not in ("size", "text_crc32", "shard", "slot")]
    out = docs.select(*kept, size.alias("size"), crc.alias("text_crc32"), key.alias(k1), key2.alias(k2))
    out = out.withColumns({in_shard: shard_of(k1, k2), in_cell: cell_of(F.col(k1), a), in_sub: cell_of(F.col(k2), b)})
    rank = F.row_number().over(Window.partitionBy(in_shard, in_cell, in_sub).orderBy(k1, k2, "size"))
    out = out.withColumn(own + "r", rank).join(counts, [in_shard, in_cell, in_sub])
    return out.withColumns({"shard": F.col(in_shard), "slot": (F.col(first) + F.col(own + "r") - 1).cast("long")}).select(*names, "size", "text_crc32", "shard", "slot")
