"""Lineage of iterative operators is cut by checkpoints in storage that all executors see."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df as a checkpoint in the folder of spark.checkpoint.dir. Only a local session gets a folder of its own where that is unset."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        at = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not at and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors see")
        sc.setCheckpointDir(at or "file://" + tempfile.mkdtemp(prefix="foliant-"))
    return df.checkpoint()
