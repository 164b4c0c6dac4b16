"""Frames that are worked out once."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def kept(df: DataFrame) -> DataFrame:
    """df, worked out once: a checkpoint in the folder that the cluster shares. Only a local session gets its own."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        root = context.getConf().get("spark.checkpoint.dir")
        if not root and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(root or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()
