"""Cutting the lineage of iterative jobs."""

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the folder of ``spark.checkpoint.dir``; on a local master without it, in a temporary folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="airgrid-"))
    return df.checkpoint()
