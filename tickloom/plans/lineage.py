"""Cuts the lineage of a loop's state."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df from a checkpoint in spark.checkpoint.dir, which driver and executors share; in local mode, where that is unset, in a
    temporary folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        if not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tickloom-"))
    return df.checkpoint()
