"""Merkle manifest of a dataset, and proofs that a recursive query climbs.

Every row is a leaf.  The leaves of a group stand in order of their id; every ``FANOUT`` consecutive nodes become one node,
level by level, until one remains: the group's subroot.  Subroots, in order of their groups, grow into the root in the same
way.  The built levels are stored as node rows that name their parent and hold the digests of their children.

A recursive query then climbs from the leaves to the root.  Leaves of one run share all siblings above it, so they climb in one
row: an array of their hashes, each folded on its own, and the siblings met so far, once.  Near the root all rows meet the same
few nodes; those are stored in as many copies as they have leaves for, so that no join key grows hot.

Digests are kept as 32 bytes and hashed as lowercase hexadecimal text.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import release, stage

FANOUT = 16
#: Runs of leaves that meet one copy of a node, and copies of a node at most.
RUNS_A_COPY, MOST_COPIES = 16, 1 << 16
#: While a recursive query runs: no limit of rows, of which there is one for each run of leaves and level; and partitions as many as
#: the session shuffles to, since the whole result goes into as many as the last, empty level has.
RECURSION = {"spark.sql.cteRecursionRowLimit": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}


def leaf_digest(*values: Column) -> Column:
    """Digest of a row: each value as ``-`` if null, else its UTF-8 byte count, ``:`` and itself (numbers in decimal)."""
    texts = [v.cast("string") for v in values]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _others(blob: str, pos: str) -> str:
    """SQL for the digests of a run without the one at ``pos``: those before it and those behind it."""
    return f"substring({blob}, 1, 32 * {pos}), substring({blob}, 32 * {pos} + 33)"


def _fold(blob: str, pos: str, own: str) -> str:
    """SQL for the digest of a run in which ``own`` stands at ``pos``."""
    before, behind = _others(blob, pos).split("), ")
    return f"unhex(sha2(cast(lower(hex(concat({before}), {own}, {behind}))) as binary), 256))"


def _numbered(rows: DataFrame, group: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """``rows``, ranged by group and ``order`` and staged, with ``place`` (partition and row in it), and one row for each group and
    partition: first place, rows of the group before it (``before``) and in all (``left``).  No group is held by one task:
    only its counts are."""
    tie = rows.withColumn("tie", F.rand(5))  # rows that are equal in all of these may be many
    keys = [F.col(group).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order], F.col("tie")]
    table = stage(tie.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie").withColumn("place", F.monotonically_increasing_id()))
    spans = table.groupBy(group, F.shiftright("place", 33).alias("part")).agg(F.min("place").alias("first"), F.count("*").alias("n"))
    own = Window.partitionBy(group)
    before = F.sum("n").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return table, spans.withColumns({"before": F.coalesce(before, F.lit(0)), "left": F.sum("n").over(own)}).drop("n")


def _placed(table: DataFrame, spans: DataFrame, group: str, number: str) -> DataFrame:
    """The number of each row in its group, from 0, and what else ``spans`` holds."""
    here = spans.withColumnRenamed(group, "of")
    match = (F.shiftright(table["place"], 33) == here["part"]) & table[group].eqNullSafe(here["of"])
    return table.join(here, match).withColumn(number, F.col("place") - F.col("first") + F.col("before")).drop("of", "part", "place", "first", "before")


def _blob(digests: Column) -> Column:
    return F.unhex(F.array_join(F.transform(digests, F.hex), ""))


def _digest(blob: str) -> Column:
    return F.unhex(F.sha2(F.lower(F.hex(blob)).cast("binary"), 256))


_UP = {"parent": "cast(null as string)", "pos": "cast(null as bigint)", "parent_copies": "cast(null as bigint)"}


def _copies(runs: Column) -> Column:
    return F.least(F.lit(MOST_COPIES), F.ceil(runs / RUNS_A_COPY)).cast("long")


def _grow(nodes: DataFrame, most: int) -> tuple[list[DataFrame], DataFrame, list[DataFrame]]:
    """Linked nodes below others, the nodes that remain (one of each tree), and the tables staged on the way.

    ``nodes``: node, tree, level, idx (place in the level of its tree), left (nodes of that level), runs (of leaves below), digest,
    children, folded.  ``most``: nodes of the largest tree."""
    linked, ends, staged = [], [], []
    while True:
        ends.append(nodes.filter("left = 1"))
        if most <= 1:
            return linked, reduce(DataFrame.unionByName, ends), staged
        up = F.floor(F.col("idx") / FANOUT)
        parent = F.concat_ws("/", "tree", (F.col("level") + 1).cast("string"), up.cast("string"))
        inner = nodes.filter("left > 1").withColumns({"parent": parent, "pos": F.col("idx") % FANOUT})
        linked.append(inner.withColumn("parent_copies", _copies(F.sum("runs").over(Window.partitionBy("parent")))))
        grouped = inner.groupBy(F.col("parent").alias("node"), "tree", (F.col("level") + 1).alias("level"), up.alias("idx"), F.ceil(F.col("left") / FANOUT).alias("left"))
        run = F.transform(F.array_sort(F.collect_list(F.struct("pos", "digest"))), lambda s: s["digest"])
        above = grouped.agg(F.sum("runs").alias("runs"), _blob(run).alias("children")).withColumns({"digest": _digest("children"), "folded": F.lit(None).cast("array<binary>")})
        nodes = stage(above)
        staged.append(nodes)
        most = -(-most // FANOUT)


def build(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored manifest of ``rows`` (group_key, id, leaf, tampered).

    Returns (runs, nodes).  ``runs``: node, children (digests of a run of leaves) and members (id, leaf) in order.  ``nodes``: node,
    parent, pos (place among the parent's children), parent_copies, runs (of leaves below), digest, children and, for runs of
    leaves, folded (the run's digest with each leaf replaced by its tampered one).  A group of one leaf has a run that is that leaf
    itself.  Groups and ids are ordered ascending, nulls first, text by UTF-8 bytes; rows that share an id by their digest."""
    table, spans = _numbered(rows, "group_key", ["id", "leaf"])
    groups = spans.groupBy("group_key").agg(F.first("left").alias("leaves")).withColumn("all", F.lit(0))
    trees, at = _numbered(groups, "all", ["group_key"])
    trees = stage(_placed(trees, at, "all", "tree").select(F.col("group_key").alias("key"), "tree", F.col("left").alias("n_trees"), "leaves"))
    n_trees, most = trees.agg(F.max("n_trees"), F.max("leaves")).first()
    spans = spans.join(trees.select("key", "tree"), F.col("group_key").eqNullSafe(F.col("key"))).drop("key")
    placed = _placed(table, spans, "group_key", "number")
    idx, left = F.floor(F.col("number") / FANOUT), F.ceil(F.col("left") / FANOUT)
    member = F.struct(F.col("number"), "id", "leaf", "tampered")
    grouped = placed.groupBy("tree", idx.alias("idx"), left.alias("left"), (F.col("left") == 1).alias("alone")).agg(F.array_sort(F.collect_list(member), _by_number).alias("members"))
    blob = grouped.withColumn("children", _blob(F.transform("members", lambda m: m["leaf"])))
    fold = f"transform(members, (m, i) -> if(m.tampered is null, digest, if(alone, m.tampered, {_fold('children', 'i', 'm.tampered')})))"
    digest = F.when(F.col("alone"), F.col("children")).otherwise(_digest("children"))
    runs = stage(blob.withColumn("digest", digest).withColumns({"folded": F.expr(fold), "node": F.concat_ws("/", F.col("tree").cast("string"), F.lit("1"), F.col("idx").cast("string")), "level": F.lit(1), "runs": F.lit(1).cast("long")}))
    first = runs.select("node", F.col("tree").cast("string").alias("tree"), "level", "idx", "left", "runs", "digest", "children", "folded")
    linked, subroots, staged = _grow(first, -(-(most or 0) // FANOUT))
    top = subroots.withColumns({"idx": F.col("tree").cast("long"), "tree": F.lit("top"), "level": F.lit(0), "left": F.lit(n_trees or 0).cast("long")})
    above, root, more = _grow(top, n_trees or 0)
    columns = ["node", "parent", "pos", "parent_copies", "runs", "digest", "children", "folded"]
    every = [*linked, *above, root.withColumns({k: F.expr(v) for k, v in _UP.items()})]
    nodes = stage(reduce(DataFrame.unionByName, [x.select(*columns) for x in every]))
    release(table, trees, *staged, *more)
    return runs.select("node", "children", F.transform("members", lambda m: F.struct(m["id"].alias("id"), m["leaf"].alias("leaf"))).alias("members")), nodes


def _by_number(a: Column, b: Column) -> Column:
    return (a["number"] - b["number"]).cast("int")


@contextlib.contextmanager
def _settings(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def climb(nodes: DataFrame) -> DataFrame:
    """One row for each run of leaves, climbed from it to the root by a recursive query: run, folded (a root for each leaf), siblings
    (digests beside the way, in order, above the run), subroot and root."""
    spark, name = nodes.sparkSession, f"merkle_{uuid.uuid4().hex}"
    copies = _copies(F.col("runs"))
    inner = nodes.filter("folded is null").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)))
    nodes.filter("folded is not null").createOrReplaceTempView(f"{name}_runs")
    inner.createOrReplaceTempView(f"{name}_nodes")
    found = spark.sql(f"""
        with recursive climb as (
          select node as run, parent, pos, parent_copies, folded, cast('' as binary) as siblings, digest as subroot, digest from {name}_runs
          union all
          select c.run, p.parent, p.pos, p.parent_copies, transform(c.folded, f -> {_fold("p.children", "c.pos", "f")}) as folded,
            concat(c.siblings, {_others("p.children", "c.pos")}) as siblings, if(startswith(p.node, 'top/'), c.subroot, p.digest) as subroot, p.digest
          from climb c join {name}_nodes p on p.node = c.parent and p.copy = pmod(xxhash64(c.run), c.parent_copies))
        select run, folded, siblings, subroot, digest as root from climb where parent is null""")
    with _settings(spark, RECURSION):
        out = stage(found)
    for view in ("runs", "nodes"):
        spark.catalog.dropTempView(f"{name}_{view}")
    return out


def manifest(docs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "source", doc_id: str = "doc_id", text: str = "text", tampered: Column | None = None) -> DataFrame:
    """A proof for each row: doc_id, leaf, subroot, root, proof_sha256, folded_root and verified.

    ``fields`` make the leaf.  Where ``tampered`` is true the row is checked with the ASCII letters of its text in lower case; null
    counts as false, and a null text stays null.  Null fields have a leaf of their own, a null group is the first group; rows
    that repeat each other are leaves of their own.  An empty table gives an empty result; columns other than
    ``fields`` (besides group, id and text) are not read.  One row alone is leaf, subroot and root, with no siblings.
    """
    value = {c: docs[c] for c in fields}
    odd = F.when(F.coalesce(tampered, F.lit(False)), leaf_digest(*(value | ({text: lower_ascii(docs[text])} if text in value else {})).values())) if tampered is not None else F.lit(None).cast("binary")
    rows = stage(docs.select(docs[group].alias("group_key"), docs[doc_id].alias("id"), leaf_digest(*value.values()).alias("leaf"), odd.alias("tampered")))
    runs, nodes = build(rows)
    way = climb(nodes)
    release(rows, nodes)
    each = runs.join(way, runs.node == way.run).select("children", "siblings", "folded", "subroot", "root", F.posexplode("members").alias("pos", "m"))
    proof = F.expr(f"sha2(cast(lower(hex(concat({_others('children', 'pos')}, siblings))) as binary), 256)")
    show = lambda c: F.lower(F.hex(c))
    ends = F.element_at("folded", F.col("pos") + 1)
    return each.select(F.col("m.id").alias("doc_id"), show("m.leaf").alias("leaf"), show("subroot").alias("subroot"), show("root").alias("root"), proof.alias("proof_sha256"), show(ends).alias("folded_root"), (ends == F.col("root")).alias("verified"))
