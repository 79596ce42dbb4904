"""Benchmark decontamination as a prefix-filtered set join.

Every item window (``window`` consecutive words; a shorter item is one window) is a set of word shingles.  A window occurs
in a text only if all of its shingles do, so one shingle is a sufficient prefix: the rarest over the whole corpus.  Texts
emit only words near such a shingle (a Bloom filter of fixed size picks them), the shuffle join on the prefix shingle finds
candidates, length and position bounds cut them, and the words themselves are compared at last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textbytes as tb
from .scratch import stage

#: Bits of the Bloom filter (two of them for each shingle).  A larger benchmark fills it: more candidates, same results.
BLOOM_BITS = 1 << 22


def _bits(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u = h.view(np.uint64)
    return (u % np.uint64(BLOOM_BITS)).astype(np.int64), ((u >> np.uint64(40)) % np.uint64(BLOOM_BITS)).astype(np.int64)


def _bloom(shingles: DataFrame) -> np.ndarray:
    """Packed filter of the column ``h``; at most BLOOM_BITS numbers reach the driver, whatever the benchmark's size."""

    def run(batches):
        for batch in batches:
            a, b = _bits(batch.column("h").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.r_[a, b]))], ["bit"])

    held = np.zeros(BLOOM_BITS, bool)
    held[shingles.mapInArrow(tb.released(run), "bit long").distinct().toPandas()["bit"].to_numpy(np.int64)] = True
    return np.packbits(held)


def _holds(packed: np.ndarray, h: np.ndarray) -> np.ndarray:
    def at(k):
        return (packed[k >> 3] >> (7 - (k & 7)).astype(np.uint8)) & 1

    a, b = _bits(h)
    return (at(a) & at(b)).astype(bool)


def _shingles(w: tb.Words, h: np.ndarray, sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles of each size: hash, index of the first word, size."""
    parts = [(*tb.ngrams(h, w.row, k), k) for k in sizes]
    return np.concatenate([p[0] for p in parts]).view(np.int64), np.concatenate([p[1] for p in parts]), np.concatenate([np.full(len(p[0]), p[2]) for p in parts])


def item_windows(items: DataFrame, item_id: str, text: str, window: int, shingle: int) -> DataFrame:
    """(item, words, n, shingles): each window of each item; items without words have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = batch.column("item").to_pylist(), ([], [], [], [])
            for lo, _, data, offsets in tb.chunks(tb.column(batch, "text")):
                data = tb.LOWER[data]
                w = tb.words(data, offsets, tb.ALNUM)
                h = tb.hashes(data, w.start, w.end)
                raw = data.tobytes()
                for r, (a, b) in enumerate(zip(w.first, w.first[1:])):
                    if a == b:
                        continue
                    n = min(window, b - a)
                    k = min(shingle, n)
                    grams = tb.ngrams(h[a:b], w.row[a:b], k)[0].view(np.int64)
                    for s in range(a, b - n + 1):
                        out[0].append(ids[lo + r])
                        out[1].append(b" ".join(raw[x:y] for x, y in zip(w.start[s : s + n], w.end[s : s + n])).decode())
                        out[2].append(n)
                        out[3].append(grams[s - a : s - a + n - k + 1])
            kinds = (pa.string(), pa.string(), pa.int32(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], ["item", "words", "n", "shingles"])

    rows = items.select(F.coalesce(items[item_id].cast("string"), F.lit("")).alias("item"), items[text].alias("text"))
    return rows.mapInArrow(tb.released(run), "item string, words string, n int, shingles array<long>")


def find_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, shingle: int = 3) -> tuple[DataFrame, DataFrame]:
    """(documents, hits).  documents: doc_id, text_key, n_words for every row of ``docs``; hits: doc_id, text_key, start, n,
    item for every occurrence of an item window (``start`` counts words from 0).

    Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing A-Z.  Null and empty texts have no words and no
    hits; items without words are never found; a null item id counts as "".  Rows that repeat doc_id and text share
    their hits.  Either table may be empty.  Other columns, whatever their names, are not read.
    """
    windows = stage(item_windows(items, item_id, item_text, window, shingle).distinct())
    sizes = tuple(sorted(r[0] for r in windows.select(F.least("n", F.lit(shingle)).alias("k")).distinct().collect()))
    rows = docs.select(docs[doc_id].alias("doc_id"), F.xxhash64(docs[text]).alias("text_key"), docs[text].alias("text"))
    grams = windows.select("words", "n", F.posexplode("shingles").alias("off", "h")).distinct()
    everything = _bloom(grams.select("h"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros(0, np.int64)]
            for _, _, data, offsets in tb.chunks(tb.column(batch, "text")):
                w = tb.words(tb.LOWER[data], offsets, tb.ALNUM)
                if sizes:
                    s = _shingles(w, tb.hashes(data, w.start, w.end, tb.LOWER), sizes)[0]
                    found.append(s[_holds(everything, s)])
            h, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], ["h", "seen"])

    seen = rows.select("text").mapInArrow(tb.released(count), "h long, seen long").groupBy("h").agg(F.sum("seen").alias("seen"))
    rarest = F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "off", "h")).alias("r")
    prefix = stage(grams.join(seen, "h", "left").groupBy("words", "n").agg(rarest).select("words", "n", "r.off", "r.h"))
    wanted = _bloom(prefix.select("h"))
    reach = window - 1

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("h", pa.int64()), ("pos", pa.int32()), ("before", pa.int32()), ("near", pa.string())]))
        for batch in batches:
            for lo, hi, data, offsets in tb.chunks(tb.column(batch, "text")):
                data = tb.LOWER[data]
                w = tb.words(data, offsets, tb.ALNUM)
                cands: list[list] = [[] for _ in range(hi - lo)]
                if sizes:
                    h, at, _ = _shingles(w, tb.hashes(data, w.start, w.end), sizes)
                    hit = np.flatnonzero(_holds(wanted, h))
                    raw = data.tobytes()
                    for g, i in zip(h[hit].tolist(), at[hit].tolist()):
                        r = int(w.row[i])
                        a, b = max(int(w.first[r]), i - reach), min(int(w.first[r + 1]), i + reach + 1)
                        near = b" ".join(raw[x:y] for x, y in zip(w.start[a:b].tolist(), w.end[a:b].tolist())).decode()
                        cands[r].append({"h": g, "pos": i - int(w.first[r]), "before": i - a, "near": near})
                cols = [batch.column("doc_id")[lo:hi], batch.column("text_key")[lo:hi], pa.array(np.diff(w.first)), pa.array(cands, kind)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "text_key", "n_words", "cands"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    read = stage(rows.mapInArrow(tb.released(candidates), f"doc_id {kind}, text_key long, n_words long, cands array<struct<h:long,pos:int,before:int,near:string>>"))
    near = read.select("doc_id", "text_key", "n_words", F.explode("cands").alias("c")).distinct()
    near = near.select("doc_id", "text_key", "n_words", "c.*").join(prefix, "h").withColumn("start", F.col("pos") - F.col("off"))
    fits = (F.col("start") >= 0) & (F.col("start") + F.col("n") <= F.col("n_words"))
    found = near.filter(fits).filter(F.array_join(F.slice(F.split("near", " "), F.col("before") - F.col("off") + 1, F.col("n")), " ") == F.col("words"))
    hits = found.select("doc_id", "text_key", "start", "n", "words").join(windows.select("words", "n", "item"), ["words", "n"])
    return read.select("doc_id", "text_key", "n_words"), hits.select("doc_id", "text_key", "start", "n", "item")


def contamination(docs: DataFrame, items: DataFrame, **names) -> DataFrame:
    """doc_id, text_key, n_words, n_hit, n_items, item_ids (sorted), contaminated: one row for each row of ``docs``."""
    read, hits = find_items(docs, items, **names)
    key = ["doc_id", "text_key"]
    spans = hits.groupBy(*key, "start").agg(F.max(F.col("start") + F.col("n")).alias("end"))
    earlier = F.max("end").over(Window.partitionBy(*key).orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    gain = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce("earlier", F.lit(0))))
    words = spans.withColumn("earlier", earlier).groupBy(*key).agg(F.sum(gain).alias("n_hit"))
    found = hits.groupBy(*key).agg(F.array_sort(F.collect_set("item")).alias("item_ids"))
    both = words.join(found, (words.doc_id.eqNullSafe(found.doc_id)) & (words.text_key == found.text_key)).select(words["*"], "item_ids")
    out = read.join(both, read.doc_id.eqNullSafe(both.doc_id) & (read.text_key == both.text_key), "left")
    hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return out.select(read["*"], hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"), (hit > 0).alias("contaminated"))
