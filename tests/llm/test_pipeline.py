"""Every stage of the corpus pipeline on null and repeated doc_ids, against brute force."""

import collections
import hashlib
import re

import pytest

import corpus_pipeline as cp
from airgrid.llm.mixing import lattice_step, targets
from airgrid.llm.toxicity import fit

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string"


def words(prefix, n):
    return " ".join(f"{prefix}{i}" for i in range(n))


def corpus():
    rows = [(None, words(f"n{k}x", 30), "a") for k in range(9)]
    rows += [(None, words("n0x", 29) + " end", "b"), (None, words("n0x", 30), "a")]
    rows += [(7, words("p", 30), "a"), (7, words("q", 30), "a"), (7, words("q", 29) + " end", "b"), (7, words("q", 30), "a"), (3, words("p", 29) + " end", "a")]
    rows += [(k, words(f"u{k}x", 20 + k), "b" if k % 2 else None) for k in (20, 21, 21, 22, 23)]
    return rows + [(None, None, "a"), (None, "", "b"), (None, " \n", "b"), (7, "", "a"), (7, "", "a")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


def rows_of(df):
    return collections.Counter((r.doc_id, r.text, r.source) for r in df.collect())


def test_toxicity_stage(spark, docs, tmp_path):
    labelled = [(1000 + i, words("w", 12) + (" vile" if i % 2 else " kind"), "a") for i in range(80)]
    spark.createDataFrame([(i, n % 2) for n, (i, _, _) in enumerate(labelled)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    more = [(None, "vile words w1 w2 w3", "a"), (None, "vile words w1 w2 w4", "a"), (7, "vile w5 w6 w7", "b"), (7, "kind w5 w6 w7", "b")]
    all_rows = labelled + corpus() + more
    d = spark.createDataFrame(all_rows, SCHEMA).repartition(3)
    import pyarrow as pa

    from airgrid.llm import textbytes as tb
    from airgrid.llm.toxicity import read

    net = fit(d, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    want = collections.Counter()
    for row in all_rows:
        score = [net.score(read(data, offsets))[0] for _, _, data, offsets in tb.chunks(pa.array([row[1]], pa.large_string()))]
        if score[0] < 0.3:
            want[row] += 1
    assert 0 < sum(want.values()) < len(all_rows)
    assert rows_of(cp.drop_toxic(spark, d, str(tmp_path))) == want


def test_near_duplicate_stage(spark, docs):
    rows = corpus()
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := WORD.findall(t or "")) else set() for _, t, _ in rows]
    label = list(range(len(rows)))
    for _ in rows:
        for a, x in enumerate(sets):
            for b, y in enumerate(sets):
                if x and y and 100 * len(x & y) >= 80 * len(x | y):
                    label[a] = label[b] = min(label[a], label[b])
    component = {t: k for (_, t, _), k, s in zip(rows, label, sets) if s}
    ids = collections.defaultdict(set)
    for (i, _, _), k, s in zip(rows, label, sets):
        if s:
            ids[k].add(i)
    got = rows_of(cp.one_of_each_group(spark, docs, ""))
    assert not got - collections.Counter(rows)
    kept = collections.Counter((component[t], i) for (i, t, _), n in got.items() if t in component for _ in range(n))
    assert kept == collections.Counter((k, min((i for i in x if i is not None), default=None)) for k, x in ids.items())
    assert {r: n for r, n in got.items() if r[1] not in component} == collections.Counter(r for r, s in zip(rows, sets) if not s)


def test_decontamination_stage(spark, docs, tmp_path):
    items = [words("n3x", 12), words("q", 11), "u20x4 u20x5 u20x6"]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    windows = {tuple(w[a : a + n]) for t in items for w in [t.split()] for n in [min(10, len(w))] for a in range(len(w) - n + 1)}
    want = collections.Counter()
    for row in corpus():
        w = (row[1] or "").split()
        want[row] += not any(tuple(w[a : a + n]) in windows for n in (3, 10) for a in range(len(w) - n + 1))
    assert rows_of(cp.drop_contaminated(spark, docs, str(tmp_path))) == +want


def test_mixing_stage(spark, docs):
    rows = [(i, t, s, len(WORD.findall(t or ""))) for i, t, s in corpus()]
    sources = sorted({r[2] for r in rows}, key=lambda s: (s is None, s))
    total = [sum(r[3] for r in rows if r[2] == s) for s in sources]
    want, texts = collections.Counter(), collections.defaultdict(collections.Counter)
    for s, n, goal in zip(sources, total, targets(list(zip(sources, total)))):
        take, at = min(int(goal + 0.5), 3 * n), 0
        order = lambda r: (hashlib.md5("|".join([str(x) for x in (r[0], r[3]) if x is not None] + ["7"]).encode()).hexdigest(), r[0] is not None, r[0] or 0, r[3])
        for i, t, _, size in sorted((r for r in rows if r[2] == s), key=order):
            want[i, s, size] += -(-(take - at) // n) if size and at < take else 0
            texts[i, s, size][t] += 1
            at += size
    got = rows_of(cp.mix_sources(spark, docs, ""))
    by = collections.Counter()
    for (i, t, s), n in got.items():
        key = (i, s, len(WORD.findall(t or "")))
        by[key] += n
        held, rows_here = texts[key][t], sum(texts[key].values())
        assert held * (want[key] // rows_here) <= n <= held * -(-want[key] // rows_here)
    assert by == +want


def test_mixing_stage_carries_the_schedule_to_the_shards(spark, docs):
    more = [(100 + i, words(f"m{i}x", 3 + 37 * i % 400), "c" if i % 3 else "a") for i in range(40)] + [(100, words("m0y", 3), "a"), (None, words("z", 600), "b")]
    rows = [(i, t, s, len(WORD.findall(t or ""))) for i, t, s in corpus() + more]
    sources = sorted({r[2] for r in rows}, key=lambda s: (s is None, s))
    total = [sum(r[3] for r in rows if r[2] == s) for s in sources]
    take = [min(int(t + 0.5), 3 * n) for t, n in zip(targets(list(zip(sources, total))), total)]
    owner = [s for s, t in zip(sources, take) for _ in range(-(-t // 256))]
    order = [owner[i * lattice_step(len(owner)) % len(owner)] for i in range(len(owner))]
    d = docs.union(spark.createDataFrame(more, SCHEMA))
    got = cp.shard(spark, cp.mix_sources(spark, d, "").repartition(3), "").collect()
    slots, starts, whole = collections.defaultdict(list), collections.Counter(), collections.Counter()
    for r in got:
        size, words_ = len(WORD.findall(r.text)), sum(p.words for p in r.mix_pieces)
        assert 0 < words_ <= size and list(r.mix_pieces) == sorted(r.mix_pieces)
        whole[r.source] += words_ < size
        starts[r.doc_id, r.text, r.source, r.mix_epoch] += 1
        text = iter(WORD.findall(r.text))
        for p in r.mix_pieces:
            slots[p.slot].append((p.start, r.source, [next(text) for _ in range(p.words)]))
    assert sorted(slots) == list(range(len(owner))) and all(n <= 1 for n in whole.values())
    held = collections.Counter((i, t, s) for i, t, s, _ in rows)
    assert all(n <= held[key[:3]] for key, n in starts.items())
    read = {s: [] for s in sources}
    for slot, source in enumerate(order):
        pieces = sorted(slots[slot])
        assert {p[1] for p in pieces} == {source} and [p[0] for p in pieces] == [sum(len(q[2]) for q in pieces[:n]) for n in range(len(pieces))]
        read[source] += [w for p in pieces for w in p[2]]
    for s, n, t in zip(sources, total, take):  # each source's slots, in order, hold its texts again and again
        assert len(read[s]) == t and read[s][n:] == read[s][: max(0, t - n)]
        texts = sum((collections.Counter(WORD.findall(x or "")) for _, x, y, _ in rows if y == s), collections.Counter())
        assert t < n or collections.Counter(read[s][:n]) == texts


def test_sharding_stage(spark, docs):
    got = cp.shard(spark, docs, "").collect()
    assert collections.Counter((r.doc_id, r.text, r.source) for r in got) == collections.Counter(corpus())
    for k in {r.shard for r in got}:
        assert 0 <= k < 8 and sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))
    assert all(r["size"] == len((r.text or "").encode()) + 1 for r in got)
