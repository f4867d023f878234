"""Rollups over unbounded sources.

State is kept by watermark; every micro-batch's changed groups are written to the shared folder
under the batch's number, so that a batch that runs again overwrites its own output only, and the
result is the last version of each group.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from meterlark.functions.scalars import bucket
from meterlark.operators import perf
from meterlark.session import _shared_dir, prepare

#: How late rows may come behind the latest one seen; state is kept as long, later rows are dropped. Pass a shorter time where a source's rows come sooner.
LATEST = "400 days"


def watch(spark: SparkSession, path: str, per_batch: int = 64) -> DataFrame:
    """A parquet folder, or a single file of a folder, as a stream, with event_time from created_at in seconds."""
    schema = prepare(spark).read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        rows = reader.parquet(path)
    else:
        folder, _, name = path.rpartition("/")
        rows = reader.option("pathGlobFilter", name).parquet(folder)
    return rows.withColumn("event_time", F.timestamp_seconds("created_at"))


def once(rows: DataFrame, key: str, within: str = "1 hour") -> DataFrame:
    """Rows delivered again within a time are dropped."""
    return rows.withWatermark("event_time", within).dropDuplicatesWithinWatermark([key])


def tumbling(rows: DataFrame, keys: list[str | Column], measures: list[Column], late: str = LATEST) -> DataFrame:
    return rows.withWatermark("event_time", late).groupBy(*keys).agg(*measures)


def drain(sums: DataFrame, keys: list[str], upsert: Callable[[DataFrame, int], None] | None = None, mode: str = "update") -> DataFrame:
    """Runs a stream of updated groups until its source is used up; gives the last version of each group."""
    spark = sums.sparkSession
    at = f"{_shared_dir(spark).rstrip('/')}/streams/{uuid.uuid4().hex}"
    values = [c for c in sums.columns if c not in keys]

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={number}")

    stream = sums.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(upsert or write).start()
    stream.awaitTermination()
    empty = spark.createDataFrame([], sums.schema).withColumn("batch", F.lit(0))
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/out")
    written = spark.read.parquet(f"{at}/out") if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path) else empty
    return written.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v")).select(*keys, "v.*")


def hourly_usage(spark: SparkSession, path: str, late: str = LATEST) -> DataFrame:
    """(model_name, hour, count, quota) of consumption."""
    rows = watch(spark, path).filter("type = 2")
    sums = tumbling(rows, ["model_name", bucket(F.col("created_at"), 3600).alias("hour")], [F.count("*").alias("count"), F.sum("quota").alias("quota")], late)
    return drain(sums, ["model_name", "hour"])


def perf_buckets(spark: SparkSession, path: str, late: str = LATEST) -> DataFrame:
    """The rollup of performance samples: every bucket as it stands when the source is used up."""
    return drain(perf.rollup(watch(spark, path).withWatermark("event_time", late)), perf.KEYS)


def perf_completed(spark: SparkSession, path: str, late: str) -> DataFrame:
    """The rollup's buckets that are complete: they are written once, when the watermark has passed their end."""
    hour = F.window("event_time", "1 hour")
    sums = perf.rollup(watch(spark, path).withWatermark("event_time", late), at=hour)
    sums = sums.select("model_name", "group_name", F.unix_timestamp("bucket.start").alias("bucket"), *perf.COUNTERS)
    return drain(sums, perf.KEYS, mode="append")


def user_deltas(spark: SparkSession, path: str) -> DataFrame:
    """(user_id, requests, used_quota) of consumption: each micro-batch is summed up by itself and adds its deltas, without state."""
    rows = watch(spark, path).filter("type = 2").select("user_id", "quota")
    at = f"{_shared_dir(spark).rstrip('/')}/streams/{uuid.uuid4().hex}"

    def add(batch: DataFrame, number: int) -> None:
        deltas = batch.groupBy("user_id").agg(F.count("*").alias("requests"), F.coalesce(F.sum("quota"), F.lit(0)).alias("used_quota"))
        deltas.write.mode("overwrite").parquet(f"{at}/out/batch={number}")

    rows.writeStream.option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(add).start().awaitTermination()
    path_out = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/out")
    if not path_out.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path_out):
        return rows_of_none(spark, "user_id long, requests long, used_quota long")
    return spark.read.parquet(f"{at}/out").groupBy("user_id").agg(F.sum("requests").alias("requests"), F.sum("used_quota").alias("used_quota"))


def rows_of_none(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)
