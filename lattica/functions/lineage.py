"""Cutting lineage with reliable checkpoints in the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder: ``spark.checkpoint.dir``, or one of our own in local mode only."""
    context = spark.sparkContext
    there = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if there is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        there = tempfile.mkdtemp(prefix="lattica-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(there)
    return there


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and read from the shared folder from then on."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
