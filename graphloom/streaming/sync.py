"""Incremental sync as a stream: snapshots of files arrive as Parquet, and a table of the current ones is kept by hash.

Rows lie in BUCKETS buckets by the hash of their path. A micro-batch writes new versions of the buckets that its paths touch,
under its own number, and then a new list of which version each bucket has. A batch that runs again writes the same, and
readers see whole lists. Old versions of buckets stay until compact() drops what no list of the last ones names."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "path string, content string, deleted boolean, at timestamp"
STORED = "path string, content string, content_hash string"
BUCKETS = 64


def bucket_of(path: Column) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(BUCKETS)).cast("int")


def _file(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, store: str) -> tuple[int, dict[int, int]]:
    """The last batch and the version of each bucket that has rows (at most BUCKETS of them)."""
    path, fs = _file(spark, f"{store}/CURRENT")
    if not fs.exists(path):
        return -1, {}
    told = json.loads(spark.read.text(f"{store}/CURRENT", wholetext=True).first()[0])
    return told["batch"], {int(k): v for k, v in told["buckets"].items()}


def _read(spark: SparkSession, store: str, buckets: dict[int, int]) -> DataFrame:
    if not buckets:
        return spark.createDataFrame([], STORED)
    return spark.read.schema(STORED).parquet(*[f"{store}/v{v}/bucket={b}" for b, v in buckets.items()])


def current(spark: SparkSession, store: str) -> DataFrame:
    return _read(spark, store, versions(spark, store)[1])


def apply_batch(batch: DataFrame, number: int, store: str) -> None:
    """The latest change of each path wins; files that the batch does not name, and buckets without any of its paths, stay."""
    spark = batch.sparkSession
    last, buckets = versions(spark, store)
    if last >= number:
        return
    order = Window.partitionBy("path").orderBy(F.desc("at"), F.desc("content"))
    new = batch.withColumn("k", F.row_number().over(order)).where("k = 1").withColumns({"content_hash": F.sha2(F.col("content").cast("binary"), 256), "bucket": bucket_of(F.col("path"))})
    touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # at most BUCKETS
    old = _read(spark, store, {b: buckets[b] for b in touched if b in buckets})
    kept = old.join(new.select("path"), "path", "left_anti").withColumn("bucket", bucket_of(F.col("path")))
    fresh = new.where(~F.coalesce("deleted", F.lit(False))).select("path", "content", "content_hash", "bucket")
    rows = kept.unionByName(fresh).repartition("bucket")
    rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{store}/v{number}")
    for b in touched:
        path, fs = _file(spark, f"{store}/v{number}/bucket={b}")
        buckets.pop(b, None)
        if fs.exists(path):
            buckets[b] = number
    path, fs = _file(spark, f"{store}/CURRENT")
    out = fs.create(path, True)
    out.write(bytearray(json.dumps({"batch": number, "buckets": buckets}).encode()))
    out.close()


def compact(spark: SparkSession, store: str) -> None:
    """Drops versions of buckets that are not current. Not to be called while others read an older list."""
    last, buckets = versions(spark, store)
    root, fs = _file(spark, store)
    for version in fs.listStatus(root):
        name = version.getPath().getName()
        if name.startswith("v"):
            for part in fs.listStatus(version.getPath()):
                at = part.getPath().getName()
                if at.startswith("bucket=") and buckets.get(int(at[7:])) != int(name[1:]):
                    fs.delete(part.getPath(), True)


def sync_stream(spark: SparkSession, incoming: str, store: str, checkpoint: str, **trigger):
    """Starts the stream; trigger(availableNow=True) unless told otherwise."""
    rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(incoming)
    return rows.writeStream.foreachBatch(lambda b, n: apply_batch(b, n, store)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
