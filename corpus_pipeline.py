"""A corpus from raw documents, in five stages; each stage reads the table that the one before wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from airgrid.llm.decontaminate import contamination
from airgrid.llm.jaccard_join import near_duplicates
from airgrid.llm.mixing import mix
from airgrid.llm.scratch import release, stage
from airgrid.llm.sharding import shard_by_bytes
from airgrid.llm.toxicity import clean_only, fit


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go.  The network learns from labelled rows of ``docs``."""
    return clean_only(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the row with the least doc_id stays (of rows that share it, one).  Texts without
    words are no copies of each other: all stay."""
    found = near_duplicates(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("k")
    grouped = found.filter("n_shingles > 0").groupBy("component").agg(first).select("k.doc_id", "k.text_key")
    keyed = docs.withColumn("__key", F.xxhash64("text"))
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)) > 0
    match = keyed.doc_id.eqNullSafe(grouped.doc_id) & (keyed["__key"] == grouped.text_key)
    chosen = keyed.filter(words).join(grouped, match, "left_semi").dropDuplicates(["doc_id", "__key"])
    return chosen.union(keyed.filter(~words)).drop("__key")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark window occurs go."""
    bad = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).filter("contaminated").select("doc_id", "text_key").distinct()
    match = docs.doc_id.eqNullSafe(bad.doc_id) & (F.xxhash64(docs.text) == bad.text_key)
    return docs.join(bad, match, "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix starts it, with the whole text and its place in the schedule; documents that the mix
    doesn't reach go.  mix_epoch counts the rounds of its source; mix_pieces says, in order, in which slots its words stand: slot,
    start (words of the slot before it) and words.  Only where the mix ends within a text they are fewer than its words."""
    names = [c for c in docs.columns if c not in ("mix_epoch", "mix_pieces")]
    row = ["__row", "__more"]  # 128 bits of all columns: rows that agree in them are equal, and any stands for all
    whole = [x for c in names for x in (docs[c], docs[c].isNull())]
    keyed = docs.select(*names, F.xxhash64(*whole).alias(row[0]), F.xxhash64(F.lit(1), *whole).alias(row[1]))
    _, pieces = mix(keyed, keep=tuple(row))
    piece = F.struct("slot", "start", F.col("part").alias("words"))
    starts = pieces.groupBy(*row, "source", "at", F.col("epoch").alias("mix_epoch")).agg(F.array_sort(F.collect_list(piece)).alias("mix_pieces"))
    one = keyed.withColumn("__n", F.row_number().over(Window.partitionBy(*row).orderBy("doc_id"))).filter("__n = 1")
    return one.join(starts.drop("source", "at"), row).select(*names, "mix_epoch", "mix_pieces")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Eight shards of near equal bytes, with the text and its places in the mix."""
    return shard_by_bytes(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", one_of_each_group),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: The first stage is a trained network; tests/llm/test_pipeline.py holds each stage against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, step in STAGES[:-1]:
        read, docs = docs, stage(step(spark, docs, sf_dir))
        release(read)
    return STAGES[-1][1](spark, docs, sf_dir)
