"""Mix sources to target weights on a low-discrepancy schedule (DataFrame operations only).

Targets are water-filled.  Each source's texts stand in a shuffled order, repeated as often as its target needs, and are
cut into blocks of ``block`` words.  The mix has one slot for each block.  Slot i falls on the point i * m mod N of a
golden-ratio lattice (m near N / golden ratio, no common factor with N), so the N points are spread evenly and each is
hit once; cumulative block counts map points to sources.  A source's slots, ranked, take its blocks in order.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import stage

WORD = r"[^\x20\x09-\x0D]+"
#: Ranges of the shuffled order (three hex digits of a hash) and of the slots, in which running sums start anew: no sum
#: runs over a whole source.
CELLS = 4096


def targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0) -> list[float]:
    """Words to take from each source, given (source, words) in order: shares of the total by repeating weights, none above
    ``most`` times its size; what is above is shared anew by weight among the rest."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    out, free, left = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s[1] > 0], float(sum(s[1] for s in sizes))
    while free:
        level = left / sum(w[i] for i in free)
        over = [i for i in free if w[i] * level > most * sizes[i][1]]
        if not over:
            for i in free:
                out[i] = w[i] * level
            break
        for i in over:
            out[i] = most * sizes[i][1]
            left -= out[i]
        free = [i for i in free if i not in set(over)]
    return out


def _numbered(cells: DataFrame, by: str, value: str) -> DataFrame:
    """Adds ``before``: the sum of ``value`` over earlier cells of the same ``by``."""
    w = Window.partitionBy(by).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    return cells.withColumn("before", F.coalesce(F.sum(value).over(w), F.lit(0)))


def sized(docs: DataFrame, keep: tuple[str, ...] = (), doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    size = F.coalesce(F.regexp_count(docs[text], F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(docs[doc_id].alias("doc_id"), docs[source].alias("source"), size.alias("size"), *[docs[c] for c in keep])


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0, block: int = 256, seed: int = 7, keep: tuple[str, ...] = (), **names) -> tuple[DataFrame, DataFrame]:
    """(plan, pieces).

    plan: doc_id, source, size (words), source_size, target, taken, copies (how often the mix starts the text), first_slot
    (the slot in which it starts first; null if it never does): one row for each row of ``docs``.  pieces: slot, source, doc_id, at (words of the source before the text), epoch, start (words of
    the slot's block before the piece), part (words of the text that lie in the block); slots and starts ascend within an epoch of a text.
    Columns of ``docs`` named in ``keep`` go into the pieces and decide the order of texts that share doc_id and size.
    Null texts and texts without words have size 0 and are never taken.  A null source is a source of its own, last in
    order.  Repeated rows count each for itself; null ids are allowed.  A table without words yields targets of 0, an
    empty one no rows.  The number of sources must fit the driver (one row for each); other columns are not read.
    """
    spark = docs.sparkSession
    rows = stage(sized(docs, keep, **names))
    sources = [(r.source, r.words) for r in rows.groupBy("source").agg(F.sum("size").alias("words")).orderBy(F.col("source").asc_nulls_last()).collect()]
    goal = targets(sources, weights, most)
    whole = [min(int(t + 0.5), int(most * n)) for t, (_, n) in zip(goal, sources)]
    slots = [-(-t // block) for t in whole]
    total = sum(slots)
    table, upto = [], 0
    for k, ((name, n), t, take, s) in enumerate(zip(sources, goal, whole, slots)):
        table.append((k, name, n, t, take, upto, upto + s))
        upto += s
    facts = spark.createDataFrame(table, "k int, source string, source_size long, target double, take long, lo long, hi long")

    # a shuffled order of each source: ranges of a hash, then the hash within them
    h = F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), F.col("size").cast("string"), F.lit(str(seed))).cast("binary"))
    cell = F.conv(F.substring(h, 1, 3), 16, 10).cast("int")
    facts_small = F.broadcast(facts) if len(table) <= 100_000 else facts
    placed = rows.join(facts_small, rows.source.eqNullSafe(facts.source)).select("doc_id", rows.source, "size", "source_size", "target", "take", "k", h.alias("h"), cell.alias("cell"), *keep)
    sums = _numbered(placed.groupBy("k", "cell").agg(F.sum("size").alias("words")), "k", "words").select("k", "cell", "before")
    within = Window.partitionBy("k", "cell").orderBy("h", "doc_id", "size", *keep).rowsBetween(Window.unboundedPreceding, -1)
    ordered = placed.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0))).join(sums, ["k", "cell"])
    ordered = stage(ordered.select("k", "doc_id", "source", "size", "source_size", "target", "take", (F.col("before") + F.col("inner")).alias("at"), *keep))

    # pieces of texts in blocks of the repeated source
    epochs = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("take") / F.col("source_size")).cast("int") - 1))
    runs = ordered.filter("size > 0").withColumn("epoch", F.explode(epochs))
    runs = runs.withColumn("lo", F.col("at") + F.col("epoch") * F.col("source_size"))
    runs = runs.withColumn("hi", F.least(F.col("lo") + F.col("size"), F.col("take"))).filter("lo < hi")
    parts = runs.withColumn("block", F.explode(F.sequence(F.expr(f"lo div {block}"), F.expr(f"(hi - 1) div {block}"))))
    first, last = F.greatest("lo", F.col("block") * block), F.least("hi", (F.col("block") + 1) * block)
    parts = parts.select("k", "source", "doc_id", "at", "epoch", "block", (first - F.col("block") * block).alias("start"), (last - first).alias("part"), *keep)

    scheduled = schedule(spark, total, [t[6] for t in table])
    pieces = scheduled.join(parts, ["k", "block"]).select("slot", "k", "source", "doc_id", "at", "epoch", "start", "part", *keep)
    got = pieces.groupBy("k", "at").agg(F.sum("part").alias("taken"), F.min("slot").alias("first_slot"))
    starts = F.when((F.col("size") > 0) & (F.col("at") < F.col("take")), F.ceil((F.col("take") - F.col("at")) / F.col("source_size"))).otherwise(0)
    plan = ordered.join(got.withColumn("n", F.lit(True)), ["k", "at"], "left")
    taken = F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(0).cast("long")
    first = F.when(F.col("size") > 0, F.col("first_slot"))
    return plan.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), starts.cast("long").alias("copies"), first.alias("first_slot")), pieces.drop("k")


def lattice_step(total: int) -> int:
    """Of the 64 numbers from total / golden ratio on, the one with no common factor with ``total`` whose fraction of it has the
    least sum of continued-fraction terms (the first of equals): that sum bounds how unevenly a prefix of the lattice lies."""
    start = max(1, round(total / ((1 + 5**0.5) / 2)))

    def terms(x: int) -> tuple[bool, int, int]:
        a, b, s = total, x, 0
        while b:
            a, b, s = b, a % b, s + a // b
        return a != 1, s, x

    return min(map(terms, range(start, start + 64)))[2]


def schedule(spark, total: int, upto: list[int]) -> DataFrame:
    """(slot, k, block): for each of ``total`` slots its source k and the rank of the slot among those of k."""
    if total == 0:
        return spark.createDataFrame([], "slot long, k int, block long")
    step = lattice_step(total)
    i = F.col("id")
    exact = i * F.lit(step) if total < 3_000_000_000 else i.cast("decimal(19,0)") * F.lit(step).cast("decimal(19,0)")
    point: Column = (exact % F.lit(total)).cast("long")
    per_cell = max(1024, -(-total // CELLS))
    spread = spark.range(0, total).select(i.alias("slot"), point.alias("point"), F.expr(f"cast(id div {per_cell} as int)").alias("cell"))
    # the points' line in equal stretches: how many sources end before one, and where others end in it
    width = -(-total // CELLS)
    ends = []
    for n in range(-(-total // width)):
        before, inside = bisect_right(upto, n * width), bisect_right(upto, (n + 1) * width - 1)
        ends.append((n, before, upto[before:inside]))
    stretches = F.broadcast(spark.createDataFrame(ends, "stretch long, before int, ends array<long>"))
    found = spread.withColumn("stretch", F.expr(f"point div {width}")).join(stretches, "stretch")
    found = found.select("slot", "cell", (F.col("before") + F.size(F.filter("ends", lambda u: u <= F.col("point")))).alias("k"))
    counts = _numbered(found.groupBy("k", "cell").count(), "k", "count").select("k", "cell", "before")
    rank = F.row_number().over(Window.partitionBy("k", "cell").orderBy("slot"))
    return found.withColumn("rank", rank).join(counts, ["k", "cell"]).select("slot", "k", (F.col("before") + F.col("rank") - 1).alias("block"))
