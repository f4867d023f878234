"""Session helpers: table access, worker import path, durable intermediate tables."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def prepare(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package, and pins what results depend on."""
    env = spark.sparkContext.environment
    paths = [p for p in (env.get("PYTHONPATH") or os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a local one only where that is unset and the session runs in one process (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='meterlark-')}"
        spark.sparkContext.setCheckpointDir(at)
    return at


def _drop(spark: SparkSession, at: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session ended first: the folder's owner clears it
        pass


def durable(df: DataFrame, by: str | None = None) -> DataFrame:
    """Writes ``df`` as a table in the shared checkpoint folder, in a folder for each value of the column ``by``, and reads it back.

    That cuts the lineage so that a lost executor costs its running tasks only, and later readers
    get pushdown and column pruning. The table goes when the driver's Python ends.
    """
    spark = df.sparkSession
    at = f"{_shared_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(at, partitionBy=by)
    atexit.register(_drop, spark, at)
    return spark.read.schema(df.schema).parquet(at).select(df.columns)
