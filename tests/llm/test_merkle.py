"""Merkle proofs against trees built by hand."""

import collections
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from airgrid.llm.merkle import build, climb, leaf_digest, manifest

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    levels = [nodes]
    while len(nodes) > 1:
        nodes = [digest(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
        levels.append(nodes)
    return levels


def brute(rows):
    by = collections.defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    trees = []
    for s in sorted(by, key=lambda s: (s is not None, (s or "").encode())):
        own = sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees.append((own, tree([leaf(r) for r in own])))
    top = tree([t[-1][0] for _, t in trees])
    for k, (own, levels) in enumerate(trees):
        for i, r in enumerate(own):
            odd = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None
            h, siblings = leaf((*r[:4], r[4].translate(FOLD)) if odd else r), []
            for way, at in ((levels, i), (top, k)):
                for nodes in way[:-1]:
                    lo = at // 16 * 16
                    run = nodes[lo : lo + 16]
                    siblings += [x for j, x in enumerate(run) if lo + j != at]
                    h = digest(*run[: at - lo], h, *run[at - lo + 1 :])
                    at //= 16
            yield r[0], leaf(r), levels[-1][0], top[-1][0], digest(*siblings), h, h == top[-1][0]


def corpus():
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "a", "a", "b", "é", None]), None if i % 7 == 0 else "en", i * 3, rng.choice(["Hello World", "xX", "É", "", None, "abc"])) for i in range(600)]
    rows += [(None, "a", None, None, None)] * 2 + [(None, "a", "x", None, "Z")] + [(5, "a", "x", 1, "T")] * 2 + [(9, "solo", "en", 1, "Q"), (15, "solo2", "en", 1, "Long " * 30_000)]
    return rows + [(10_000 + i, f"s{i:03d}", "en", 1, "ABC") for i in range(280)]


CASES = {"many": corpus(), "none": [], "one": [(15, "q", "en", 1, "QQ")], "one_group": [(i, None, "en", 1, "QQ") for i in range(17)], "sixteen_groups": [(i, str(i), "en", 1, "QQ") for i in range(16)]}


@pytest.mark.parametrize("case", CASES)
def test_proofs(spark, case):
    rows = CASES[case]
    d = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({c: F.lit(1) for c in ("leaf", "node", "place", "tree", "id", "tampered", "group_key")})
    got = manifest(d, tampered=F.crc32(d["doc_id"].cast("string").cast("binary")) % 5 == 0).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(brute(rows))


def test_equal_rows_are_spread_and_hot_nodes_have_copies(spark):
    d = spark.range(9000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a").alias("source"), F.lit("same").alias("text"))
    rows = d.select(F.col("source").alias("group_key"), F.col("doc_id").alias("id"), leaf_digest(d["doc_id"], d["text"]).alias("leaf"), F.lit(None).cast("binary").alias("tampered"))
    runs, nodes = build(rows)
    assert runs.count() == 563 and {len(r.members) for r in runs.collect()} == {16, 8}
    assert nodes.filter("parent is null").select("runs").first()[0] == 563
    assert nodes.agg(F.max("parent_copies")).first()[0] == 36
    way = climb(nodes).collect()
    assert len(way) == 563 and len({r.root for r in way}) == 1
    assert all(f == r.root for r in way for f in r.folded)
