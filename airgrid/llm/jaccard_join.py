"""Near-duplicate join on word shingles by Jaccard similarity: a grouped prefix join.

Shingles are ordered by rarity (a sketch of fixed size counts them over the whole corpus; any shared order is exact).  Two
sets that reach the threshold share a token of their prefixes.  Texts with equal sets are one class, classes with equal
prefix and size one group (named by a 64-bit hash).  Groups meet on prefix tokens and pass bounds on lengths, positions and,
by parity bitmaps of whole sets, on how many tokens they may differ in; what is left is verified on the sets.  So that a
large group of near copies never becomes all of its pairs, buckets are first linked to one pivot each; afterwards only
members that are still in different components are compared, all of them, so no link between components is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .components import connected_components
from .scratch import release, small_batches, stage

#: Cells of the rarity sketch, of four bits each; cells of one block; shingles that a task holds before it sends them.
SKETCH_BITS = 26
BLOCK = 1 << 14
HELD = 4_000_000
TOKEN_BITS = np.uint64(58)
#: Buckets up to this many members list all of their pairs at once; of larger ones only members of different components meet.
SMALL = 8
#: Bits of the class digest by which texts are picked before their sets are written.
PICK_BITS = 24


def _shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each shingle of k words; a row of fewer words, but not none, has its whole sequence as one."""
    data = tb.LOWER[data]
    w = tb.words(data, offsets, ~tb.SPACE)
    h = tb.hashes(data, w.start, w.end)
    grams, at = tb.ngrams(h, w.row, k)
    rows, out = [w.row[at]], [grams]
    n = np.diff(w.first)
    for size in range(1, k):
        short = np.flatnonzero(n == size)
        if len(short):
            pick = (w.first[short][:, None] + np.arange(size)).ravel()
            rows.append(short)
            out.append(tb.ngrams(h[pick], np.repeat(short, size), size)[0])
    return np.concatenate(rows), np.concatenate(out)


def _cells(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _tokens(data: np.ndarray, offsets: np.ndarray, k: int, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and token of each distinct shingle, by row and from rare to frequent.  A token holds its rarity in front."""
    row, h = _shingles(data, offsets, k)
    cell = _cells(h)
    rank = (ranks[cell >> 1] >> (4 * (cell & 1)).astype(np.uint8)) & 15
    token = (rank.astype(np.uint64) << TOKEN_BITS) | (h & np.uint64((1 << 58) - 1))
    order = np.lexsort((token, row))
    row, token = row[order], token[order]
    if len(row):
        new = np.r_[True, (row[1:] != row[:-1]) | (token[1:] != token[:-1])]
        row, token = row[new], token[new]
    return row, token.view(np.int64)


def _sums(token: np.ndarray, first: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """64-bit digest of the tokens in each range, whatever their order."""
    total = np.r_[np.zeros(1, np.uint64), np.cumsum(tb.mix(token.view(np.uint64) * np.uint64(2 * seed + 1) + np.uint64(seed)))]
    return tb.mix((total[end] - total[first]) ^ ((end - first).astype(np.uint64) << np.uint64(32)))


def _digest(token: np.ndarray, first: np.ndarray, end: np.ndarray) -> list[bytes]:
    """128-bit digest of the tokens in each range."""
    return [x.tobytes() for x in np.stack([_sums(token, first, end, seed) for seed in (3, 5)], 1)]


def _parities(token: np.ndarray, row: np.ndarray, n: np.ndarray) -> pa.Array:
    """A parity bitmap of each row's tokens as 64-bit words: a power of two of bits, at least ``n``.  Two sets differ in as many
    tokens at least as their bitmaps do in bits."""
    bits = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
    bits[n == 0] = 0
    end = np.cumsum(bits)
    at = (end - bits)[row] + (token & (bits[row] - 1))
    odd = np.bincount(at, minlength=int(end[-1]) if len(end) else 0) & 1
    held = np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, end // 64].astype(np.int32)), pa.array(held))


def _counted_blocks(cells: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Blocks of sorted cells: in each the distances of its places, one byte each; 255 stands for a stretch of 255 without one."""
    cuts = np.searchsorted(cells, np.arange(0, (1 << SKETCH_BITS) + 1, 256 * BLOCK))
    for lo, hi in zip(cuts, cuts[1:]):
        if lo == hi:
            continue
        block, at = np.divmod(cells[lo:hi].astype(np.int64), BLOCK)
        new = np.r_[True, block[1:] != block[:-1]]
        step = at - np.where(new, 0, np.r_[0, at[:-1]])
        end = np.cumsum(step // 255 + 1)
        gaps = np.full(int(end[-1]), 255, np.uint8)
        gaps[end - 1] = step % 255
        first = np.flatnonzero(new)
        offsets = np.r_[np.r_[0, end][first], end[-1]].astype(np.int32)
        spots = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(gaps)])
        yield pa.RecordBatch.from_arrays([pa.array(block[first].astype(np.int32)), spots], ["block", "spots"])


def _places(gaps: bytes) -> np.ndarray:
    step = np.frombuffer(gaps, np.uint8)
    return np.cumsum(step.astype(np.int64))[step < 255]


def _ranked_block(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Four bits for each cell of a block: the power of two by which its count passes the block's median count, 15 at most."""
    counts = np.zeros(BLOCK, np.int64)
    for batch in batches:
        for spots in batch.column("spots"):
            counts += np.bincount(_places(spots.as_py()), minlength=BLOCK)
    rank = np.minimum(15, np.log2(np.maximum(1.0, counts / max(1.0, float(np.median(counts)))))).astype(np.uint8)
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([(rank[::2] | rank[1::2] << 4).tobytes()], pa.binary())], ["block", "ranks"])


def _rarity(texts: DataFrame, k: int) -> np.ndarray:
    """Four bits for each of 2**SKETCH_BITS cells of shingles, larger for cells that are counted more often over all texts.

    Tasks sort the cells of HELD shingles at a time and send them in blocks; the driver gets half a byte for each cell,
    whatever the input.  Beyond a few shingles for each cell, those that many texts share still stand out against the median.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def sent() -> Iterator[pa.RecordBatch]:
            cells = np.concatenate([np.zeros(0, np.uint32), *held])
            held.clear()
            cells.sort()
            yield from _counted_blocks(cells)

        for batch in batches:
            for _, _, data, offsets in tb.chunks(tb.column(batch, "text")):
                held.append(_cells(_shingles(data, offsets, k)[1]).astype(np.uint32))
                if sum(map(len, held)) > HELD:
                    yield from sent()
        yield from sent()

    blocks = texts.mapInArrow(tb.released(run), "block int, spots binary")
    got = blocks.groupBy("block").applyInArrow(_ranked_block, "block int, ranks binary")
    ranks = np.zeros((1 << SKETCH_BITS) // BLOCK * (BLOCK // 2), np.uint8).reshape(-1, BLOCK // 2)
    with small_batches(texts.sparkSession):
        found = got.collect()
    for row in found:
        ranks[row.block] = np.frombuffer(row.ranks, np.uint8)
    return ranks.ravel()


def _classes(rows: DataFrame, k: int, ranks: Broadcast, percent: int) -> DataFrame:
    """Each row's class (digest of its whole set), parity bitmap, group (digest of prefix and size), size and prefix.  Of rows
    of one group that a task meets, only the first need carry the prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for batch in batches:
            for lo, hi, data, offsets in tb.chunks(tb.column(batch, "text")):
                row, token = _tokens(data, offsets, k, ranks.value)
                first = np.searchsorted(row, np.arange(hi - lo + 1))
                n = np.diff(first)
                # two sets of n and m overlap by ceil(p (n + m) / (100 + p)) at least, so by ceil(p n / 100)
                length = np.where(n > 0, n - (percent * n + 99) // 100 + 1, 0)
                group = tb.mix(_sums(token, first[:-1], first[:-1] + length, 9) + n.astype(np.uint64)).view(np.int64)
                for r, g in enumerate(group.tolist()):
                    if g in sent:
                        length[r] = 0
                    sent.add(g)
                if len(sent) > 500_000:
                    sent.clear()
                pick = np.repeat(first[:-1] - (np.cumsum(length) - length), length) + np.arange(length.sum())
                prefixes = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(length)].astype(np.int32)), pa.array(token[pick]))
                cols = [batch.column("doc_id")[lo:hi], batch.column("text_key")[lo:hi], pa.array(n), pa.array(_digest(token, first[:-1], first[1:]), pa.binary()), _parities(token, row, n), pa.array(group), prefixes]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "text_key", "n", "cid", "sig", "gid", "prefix"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(tb.released(run), f"doc_id {kind}, text_key long, n long, cid binary, sig array<long>, gid long, prefix array<long>")


def _picked(pairs: DataFrame) -> np.ndarray:
    """Packed bitmap of the first PICK_BITS bits of each ``a`` and ``b``, made of 64 bits a row: 2**18 rows at most reach the driver."""
    spot = F.conv(F.hex(F.substring("cid", 1, 3)), 16, 10).cast("long")
    ids = pairs.select(F.col("a").alias("cid")).union(pairs.select("b"))
    bit = F.expr("shiftleft(1L, cast(spot & 63 as int))")
    words = ids.select(spot.alias("spot")).groupBy(F.shiftright("spot", 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toPandas()
    held = np.zeros(1 << (PICK_BITS - 6), np.int64)
    held[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return held


def _sets(texts: DataFrame, k: int, ranks: Broadcast, pairs: DataFrame) -> DataFrame:
    """(cid, tokens) of the classes in ``pairs``, one row for each.  A bitmap keeps most other texts from being written."""
    held = _picked(pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()
        for batch in batches:
            for lo, hi, data, offsets in tb.chunks(tb.column(batch, "text")):
                row, token = _tokens(data, offsets, k, ranks.value)
                first = np.searchsorted(row, np.arange(hi - lo + 1))
                ids, sets = [], []
                for c, a, b in zip(_digest(token, first[:-1], first[1:]), first, first[1:]):
                    at = int.from_bytes(c[:3], "big")
                    if a < b and (int(held[at >> 6]) >> (at & 63)) & 1 and c not in sent:
                        sent.add(c)
                        ids.append(c)
                        sets.append(token[a:b])
                if len(sent) > 200_000:
                    sent.clear()
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], ["cid", "tokens"])

    met = stage(texts.mapInArrow(tb.released(run), "cid binary, tokens array<long>"))
    once = stage(met.groupBy("cid").agg(F.first("tokens").alias("tokens")))
    release(met)
    return once


def _possible(n: Column, i: Column, m: Column, j: Column, percent: int) -> Column:
    """Length and position bounds for a shared token at places i and j of sets of n and m.  With an overlap of o, prefixes of
    n - o + 1 and m - o + 1 tokens share one."""
    length = (100 * n >= percent * m) & (100 * m >= percent * n)
    early = (100 + percent) * F.least(n - i, m - j) >= percent * (n + m)
    return length & early


def _close(pairs: DataFrame, percent: int) -> DataFrame:
    """Of pairs with sizes n, m and bitmaps x, y those that may reach the threshold: the overlap is at least
    ceil(p (n + m) / (100 + p)), so no more than n + m less twice that may differ."""

    def folded(name: str) -> str:
        out = name
        for _ in range(1 + math.ceil(math.log2(100 / percent))):
            out = f"if(size({out}) > words, zip_with(slice({out}, 1, size({out}) div 2), slice({out}, size({out}) div 2 + 1, size({out}) div 2), (p, q) -> p ^ q), {out})"
        return out

    x, y = (F.expr(folded(c)) for c in "xy")
    sized = pairs.filter(f"100 * n >= {percent} * m and 100 * m >= {percent} * n").withColumn("words", F.least(F.size("x"), F.size("y")))
    apart = F.expr("aggregate(zip_with(x, y, (p, q) -> bit_count(p ^ q)), 0, (s, v) -> s + v)")
    return sized.withColumns({"x": x, "y": y}).filter(apart <= F.col("n") + F.col("m") - 2 * F.ceil(percent * (F.col("n") + F.col("m")) / (100 + percent)))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes whose sets reach the threshold."""
    left = pairs.join(sets.select(F.col("cid").alias("a"), F.col("tokens").alias("x")), "a")
    both = left.join(sets.select(F.col("cid").alias("b"), F.col("tokens").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.filter(100 * common >= percent * (F.size("x") + F.size("y") - common)).select("a", "b")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id, component for each row of ``docs``.

    Words are runs of ``[^\\x20\\x09-\\x0D]`` after lower-casing A-Z.  A text with fewer than k words is one shingle; null texts
    and texts without words have none, link with nothing and keep their own id.  component_id is the least non-null
    doc_id of the component (null only if all are null), so components whose ids are null or repeated may share it; component,
    the least class digest, names one component only (null for texts without words).  Repeated rows give repeated results.
    An empty table gives an empty one; other columns are not read.
    """
    rows = docs.select(docs[doc_id].alias("doc_id"), F.xxhash64(docs[text]).alias("text_key"), docs[text].alias("text"))
    texts = rows.select("text")
    ranks = docs.sparkSession.sparkContext.broadcast(_rarity(texts, k))
    read = stage(_classes(rows, k, ranks, percent))
    full = read.filter("n > 0")
    classes = stage(full.groupBy("cid", "gid", "n").agg(F.min("doc_id").alias("least_id"), F.first("sig").alias("sig")))
    head = classes.groupBy("gid").agg(F.min(F.struct("cid", "n", "sig")).alias("h"), F.count("*").alias("members"))
    head = stage(head.select("gid", F.col("h.cid").alias("head"), "h.n", "h.sig", "members"))
    buckets = stage(_buckets(full.select("gid", F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("i", "token"))))
    many = head.filter("members > 1").select("gid", "head", F.col("n").alias("m"), F.col("sig").alias("y"))
    inner = stage(classes.join(many, "gid").select("gid", "cid", "head", "n", "m", F.col("sig").alias("x"), "y"))

    def ends(pairs: DataFrame, table: DataFrame, key: str, name: str) -> DataFrame:
        """``pairs`` (a, b) with name, size and bitmap of both from ``table``."""
        one = table.select(F.col(key).alias("a"), F.col(name).alias("class_a"), "n", F.col("sig").alias("x"))
        two = table.select(F.col(key).alias("b"), F.col(name).alias("class_b"), F.col("n").alias("m"), F.col("sig").alias("y"))
        return pairs.join(one, "a").join(two, "b")

    # heads of groups with the pivots of their buckets, members of a group with its head
    led = buckets.select("pivot", F.explode("members").alias("x")).filter("x.gid <> pivot.gid").filter(_bounds("x", "pivot", percent))
    led = stage(led.select(F.col("x.gid").alias("a"), F.col("pivot.gid").alias("b")).distinct())
    pairs = _close(ends(led, head, "gid", "head"), percent).select(F.col("class_a").alias("a"), F.col("class_b").alias("b"))
    pairs = pairs.union(_close(inner.filter("cid <> head"), percent).select(F.col("cid").alias("a"), F.col("head").alias("b")))
    labels = _linked(None, pairs, texts, k, ranks, percent)

    # what is left: members of one bucket or group in different components
    named = classes.select("cid", "gid", "n", "sig").join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    named = stage(named)
    wide = inner.select("gid").distinct()
    listed = buckets.filter("size(members) > 1").select("pivot", "members", F.posexplode("members").alias("at", "x")).withColumn("y", F.explode(F.slice("members", F.col("at") + 2, SMALL)))
    listed = listed.filter("x.gid <> pivot.gid and y.gid <> pivot.gid").filter(_bounds("x", "y", percent)).select(F.col("x.gid").alias("a"), F.col("y.gid").alias("b"))
    again = [led.join(wide.withColumnRenamed("gid", c), c, "left_semi").select("a", "b") for c in "ab"]
    met = listed.union(again[0]).union(again[1]).distinct()
    one, two = (named.select(F.col("gid").alias(g), F.col("cid").alias(f"class_{g}"), F.col("label").alias(f"label_{g}")) for g in "ab")
    met = met.join(one, "a").join(two, "b").filter("label_a <> label_b").select(F.col("class_a").alias("a"), F.col("class_b").alias("b"))

    large = buckets.filter("size(members) = 1").select("token", F.explode("members").alias("x")).select("token", "x.gid", "x.n", "x.i")
    member = large.join(named.select("gid", "cid", "label"), "gid")
    mixed = member.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("token")
    member = stage(member.join(mixed, "token"))
    other = member.select("token", F.col("cid").alias("b"), F.col("n").alias("m"), F.col("i").alias("j"), F.col("label").alias("label_b"))
    rest = member.join(other, "token").filter("label < label_b").filter(_possible(F.col("n"), F.col("i"), F.col("m"), F.col("j"), percent)).select(F.col("cid").alias("a"), "b")
    within = named.join(wide, "gid", "left_semi").select("gid", "cid", "label")
    twin = within.select("gid", F.col("cid").alias("b"), F.col("label").alias("label_b"))
    same = within.join(twin, "gid").filter("label < label_b").select(F.col("cid").alias("a"), "b")
    pairs = stage(met.union(rest).union(same).distinct())
    close = _close(ends(pairs, named, "cid", "cid"), percent).select(F.col("class_a").alias("a"), F.col("class_b").alias("b"))
    labels = _linked(labels, close, texts, k, ranks, percent)
    release(head, buckets, inner, led, named, member, pairs)
    ranks.destroy()

    names = classes.select("cid", "least_id").join(labels.withColumnRenamed("node", "cid"), "cid", "left").select("cid", "least_id", F.coalesce("label", "cid").alias("label"))
    least = names.groupBy("label").agg(F.min("least_id").alias("component_id"))
    final = names.join(least, "label").select("cid", "component_id", F.col("label").alias("component"))
    out = read.select("doc_id", "text_key", "n", "cid").join(final, "cid", "left")
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "text_key", F.col("n").alias("n_shingles"), own.alias("component_id"), "component")


def _buckets(tokens: DataFrame) -> DataFrame:
    """(token, pivot, members) of tokens (gid, n, i, token) that more than one group has, after one exchange by token.

    The pivot is the member in whose prefix the token comes first, so the one with the fewest shingles of its own.  Members
    of a bucket of up to SMALL are listed in one row, those of larger ones in a row each.  (Rows are counted before repeats
    from different tasks go, so a small bucket may come in a row for each member too.)
    """
    tokens = tokens.repartition("token")
    rank = F.shiftleft(F.col("i").cast("long"), 40) + F.shiftrightunsigned("gid", 24)
    shared = tokens.groupBy("token").agg(F.min_by(F.struct("gid", "n", "i"), rank).alias("pivot"), F.min("gid").alias("lo"), F.max("gid").alias("hi"), F.count("*").alias("c")).filter("lo < hi")
    met = tokens.join(shared.select("token", "pivot", "c").hint("shuffle_hash"), "token")
    apart = F.when(F.col("c") > SMALL, F.col("gid")).otherwise(0)
    return met.groupBy("token", apart.alias("apart")).agg(F.first("pivot").alias("pivot"), F.collect_set(F.struct("gid", "n", "i")).alias("members")).drop("apart")


def _bounds(a: str, b: str, percent: int) -> Column:
    n, i, m, j = (F.col(f"{s}.{c}") for s in (a, b) for c in "ni")
    return _possible(n, i, m, j, percent)


def _linked(labels: DataFrame | None, pairs: DataFrame, texts: DataFrame, k: int, ranks: Broadcast, percent: int) -> DataFrame:
    """Labels after ``pairs`` have been verified on whole sets."""
    pairs = stage(pairs)
    if labels is not None and pairs.isEmpty():
        return labels
    sets = _sets(texts, k, ranks, pairs)
    edges = stage(_verified(pairs, sets, percent))
    release(pairs, sets)
    return _merged(labels, edges)


def _merged(labels: DataFrame | None, edges: DataFrame) -> DataFrame:
    """Labels after ``edges`` are added; only the components that they touch are worked on."""
    if labels is None:
        return connected_components(edges)
    la, lb = labels.select(F.col("node").alias("a"), F.col("label").alias("la")), labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    between = edges.join(la, "a", "left").join(lb, "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).distinct()
    moved = stage(connected_components(between))
    up = moved.select(F.col("node").alias("label"), F.col("label").alias("new"))
    old = labels.join(up, "label", "left").select("node", F.coalesce("new", "label").alias("label"))
    fresh = moved.join(labels.select("node"), "node", "left_anti")
    return stage(old.union(fresh))
