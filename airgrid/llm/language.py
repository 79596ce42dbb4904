"""Language of pages by fusing evidence: text, declared markup language, address suffix and host.

Text likelihoods are naive Bayes over hashed byte trigrams, counted over all labelled documents.  Soft counts of the text
verdicts, summed by declared language and by host, registered domain and suffix, give the likelihood of a declaration
and a prior for each host that is shrunk through domain and suffix to the whole table.  A page's own verdict is taken out
of its host's counts before it is judged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .host_reputation import domain_of, host_of, small, suffix_of
from .scratch import release, stage
from .warc import plain_text

BUCKETS = 1 << 15
#: Languages whose model the driver and a task hold at a time (64 MB).
LANGUAGES = 256


def _trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of each byte trigram inside a row."""
    d = tb.LOWER[data].astype(np.int64)
    if len(d) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    at = np.flatnonzero(row[:-2] == row[2:])
    return row[at], ((d[at] * 31 * 31 + d[at + 1] * 31 + d[at + 2]) * 2654435761 >> 9) % BUCKETS


def counted(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, bucket, n) over all rows with a language."""
    rows = docs.select(docs[lang].alias("lang"), docs[text].alias("text")).filter("lang is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            names, code = np.unique(np.array(batch.column("lang").to_pylist(), dtype=object).astype(str), return_inverse=True)
            for lo, hi, data, offsets in tb.chunks(tb.column(batch, "text")):
                row, bucket = _trigrams(data, offsets)
                here, own = np.unique(code[lo:hi], return_inverse=True)
                both = np.bincount(own[row] * BUCKETS + bucket, minlength=len(here) * BUCKETS).reshape(-1, BUCKETS)
                for k, n in zip(here, both):
                    seen[names[k]] = seen[names[k]] + n if names[k] in seen else n
            if len(seen) > LANGUAGES:
                yield from summed_up(seen)
                seen.clear()
        yield from summed_up(seen)

    def summed_up(seen: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for name, n in seen.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(n[at].astype(np.int64))], ["lang", "bucket", "n"])

    return rows.mapInArrow(tb.released(count), "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def text_model(counts: DataFrame, langs: list[str]) -> np.ndarray:
    """Log probabilities by language and bucket of some of the languages of ``counted``."""
    table = np.ones((len(langs), BUCKETS))
    got = counts.filter(F.col("lang").isin(langs)).toPandas()
    place = {x: i for i, x in enumerate(langs)}
    table[got["lang"].map(place).to_numpy(np.int64), got["bucket"].to_numpy(np.int64)] += got["n"].to_numpy(np.int64)
    return np.log(table / table.sum(1, keepdims=True))


def _likelihoods(rows: DataFrame, model: np.ndarray, temper: float, last: bool) -> DataFrame:
    """``rows`` with the tempered log likelihoods of the model's languages behind those in ``p``; from the last model on, the
    text's posteriors under equal priors, without the text."""
    keep = [f.name for f in rows.schema if f.name not in ("text", "p")]
    names = [*keep, "p"] if last else [*keep, "text", "p"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = tb.column(batch, "text")
            before = batch.column("p")
            for lo, hi, data, offsets in tb.chunks(texts):
                row, bucket = _trigrams(data, offsets)
                ll = temper * np.stack([np.bincount(row, m[bucket], hi - lo) for m in model], 1)
                ll = np.hstack([before[lo:hi].flatten().to_numpy(zero_copy_only=False).reshape(hi - lo, -1), ll])
                if last:
                    ll = np.exp(np.maximum(ll - ll.max(1, keepdims=True), -30))
                    ll /= ll.sum(1, keepdims=True)
                p = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * ll.shape[1]), pa.array(ll.ravel()))
                held = {c: batch.column(c)[lo:hi] for c in names if c != "p"} | {"p": p}
                yield pa.RecordBatch.from_arrays([held[f] for f in order], order)

    order = [f.name for f in rows.schema if f.name in names]
    return rows.mapInArrow(tb.released(run), kinds)


def declared_of(html: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?i)<html[^>]*\blang\s*=\s*[\"']?([a-z]+)", 1))


def _arrays(table: DataFrame, by: list[str], values: str, to: str) -> DataFrame:
    """Sums of arrays, place by place: a row for each key."""
    each = table.select(*by, F.posexplode(values).alias("j", "x")).groupBy(*by, "j").agg(F.sum("x").alias("x"))
    return each.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "x"))), lambda e: e["x"]).alias(to))


def identify(pages: DataFrame, docs: DataFrame, temper: float = 0.1, smooth: float = 5.0, page_id: str = "page_id", url: str = "url", html: str = "html", most: int = LANGUAGES) -> DataFrame:
    """page_id, host, declared, text_lang, lang, confidence for each row of ``pages``.

    Null or empty pages have no text evidence and rest on declaration and host; null urls have the host "".  Repeated rows
    each count.  Equal posteriors go to the first language by name.  A page declares nothing, one of the languages, or
    another one.  Without labelled documents the only language is "und".  Columns of other names are not read.

    There may be any number of languages: a page has an array with an entry for each.  The text model of ``most`` of them is
    held at a time; more are read one after the other, with the same result.
    """
    counts = stage(counted(docs))
    langs = sorted(r[0] for r in counts.select("lang").distinct().collect()) or ["und"]
    n = len(langs)
    dec = declared_of(pages[html])
    declared = F.when(dec == "", "none").when(dec.isin(langs), dec).otherwise("other")
    host = host_of(pages[url])
    read = pages.select(pages[page_id].alias("page_id"), host.alias("host"), declared.alias("declared"), plain_text(F.coalesce(pages[html], F.lit(""))).alias("text"), F.array().cast("array<double>").alias("p"))
    for lo in range(0, n, most):
        held, read = read, stage(_likelihoods(read, text_model(counts, langs[lo : lo + most]), temper, lo + most >= n))
        release(held)
    release(counts)

    whole = [0.0] * n
    for r in read.select(F.posexplode("p").alias("j", "x")).groupBy("j").agg(F.sum("x").alias("x")).collect():
        whole[r.j] = r.x
    prior = F.lit([(x + 1.0) / (sum(whole) + n) for x in whole])
    # P(declaration | language), smoothed towards the declaration's share of all pages: a row for each declaration
    said = _arrays(read, ["declared"], "p", "d").withColumn("each", F.aggregate("d", F.lit(1.0), lambda a, x: a + x))
    mass = said.agg(F.sum("each")).first()[0] or 1.0
    said = said.select("declared", F.zip_with("d", F.lit([x + smooth for x in whole]), lambda x, total: (x + smooth * F.col("each") / mass) / total).alias("said"))

    hosts = stage(_arrays(read, ["host"], "p", "h").withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))}))
    suffixes, domains = _arrays(hosts, ["suffix"], "h", "s"), _arrays(hosts, ["suffix", "domain"], "h", "d")
    chain = stage(hosts.join(domains.drop("suffix"), "domain").join(suffixes, "suffix").select("host", "h", "d", "s"))
    page = read.join(small(chain, 24 * n), "host").join(small(said, 8 * n), "declared")

    def shrunk(own: str, above: Column) -> Column:
        """The counts of a level without the page's own, shrunk towards the level above."""
        rest = F.zip_with(own, "p", lambda x, y: F.greatest(F.lit(0.0), x - y))
        total = F.aggregate(rest, F.lit(smooth), lambda a, x: a + x)
        return F.zip_with(rest, above, lambda x, y: (x + smooth * y) / total)

    for level, above in (("s", prior), ("d", F.col("s")), ("h", F.col("d"))):
        page = page.withColumn(level, shrunk(level, above))
    page = page.withColumn("post", F.zip_with(F.zip_with("p", "said", lambda x, y: x * y), "h", lambda x, y: x * y))

    def best(values: str) -> Column:
        return F.element_at(F.lit(langs), F.array_position(values, F.array_max(values)).cast("int"))

    sure = F.array_max("post") / F.aggregate("post", F.lit(0.0), lambda a, x: a + x)
    return page.select("page_id", "host", "declared", best("p").alias("text_lang"), best("post").alias("lang"), sure.alias("confidence"))
