"""Checkpoints in the folder that the cluster shares."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder. Only where all of Spark is one process (tests) may one be made on this machine."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
        if not found and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(found or f"file://{tempfile.mkdtemp(prefix='graphloom-')}")
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written once to the checkpoint folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def dealt_out(df: DataFrame, *keys: str) -> DataFrame:
    """df in as many partitions as tasks can use, for rows that are few and cost much: by their size Spark would put them in one task."""
    session = df.sparkSession
    return df.repartition(max(session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions"))), *keys)
