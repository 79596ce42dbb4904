"""Connected components of an edge table, by repeated minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import release, stage


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of ``edges`` (a, b); label is the least node that can be reached.

    Each round is two shuffles by node with map-side minima; tables in the shared folder cut the lineage.  Ends when no
    label changes.  Self-loops and repeated edges do no harm; without edges the result is empty.
    """
    both = stage(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    table = labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("label")))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        best = labels.join(near, labels.node == near.a).select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("up"), F.col("label").alias("far"))
        nxt = stage(best.join(up, best.label == up.up, "left").select("node", "was", F.least("label", F.coalesce("far", "label")).alias("label")))
        changed = nxt.filter("was <> label").limit(1).count()
        release(table)
        table, labels = nxt, nxt.select("node", "label")
        if not changed:
            release(both)
            return labels
