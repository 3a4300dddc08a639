"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import re
import string
import sys
import tempfile
import types
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase


#: Arrow batches of these rows and bytes at most keep Python workers small; Spark's own bound is 10,000 rows of any size.
SMALL = {"spark.sql.execution.arrow.maxRecordsPerBatch": "4000", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


def bound_batches(spark: SparkSession) -> None:
    """From now on Python workers of this session get small Arrow batches, unless it has a bound of its own."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        for k, v in SMALL.items():
            spark.conf.set(k, v)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Only where all of Spark is one process (tests) is one made on this machine."""
    conf = spark.sparkContext.getConf()
    found = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='graphloom-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes df once as a table in the shared folder and reads it again: lineage ends there, and a lost executor costs no rerun."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Deletes materialized tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if path.startswith(("file:" + shared_dir(spark).removeprefix("file://"), shared_dir(spark))):
                at = spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def small_batches(spark: SparkSession):
    """Inside, Python gets small Arrow batches."""
    before = {k: spark.conf.get(k) for k in SMALL}
    try:
        for k, v in SMALL.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


#: Lists of up to so many rows of ids and digests are broadcast (under 100 MB); longer ones are joined by shuffling.
MOST_LISTED = 500_000


def short(table: DataFrame, most: int = MOST_LISTED) -> DataFrame:
    """table, to be broadcast if a count of its rows proves it short."""
    return F.broadcast(table) if table.count() <= most else table


def free(name: str, *frames: DataFrame) -> str:
    """name, made longer until no column of the frames has it in any case."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. A text without multi-byte characters takes the byte-wise way, which is the same there."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def worker_cache(key: str, make):
    """What make() gave the first time in this Python worker: tasks that follow each other share loaded models."""
    held = sys.modules.setdefault("graphloom_worker_cache", types.ModuleType("graphloom_worker_cache"))
    if not hasattr(held, key):
        setattr(held, key, make())
    return getattr(held, key)
