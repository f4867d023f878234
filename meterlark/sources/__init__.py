"""Readers and writers: parquet and JDBC tables, batches by key range, merges into stored rollups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Columns that hold secrets; no reader returns them.
SECRETS = ("password", "access_token", "key", "secret")


def read(spark: SparkSession, path: str, kind: str = "parquet", **options: str) -> DataFrame:
    """A table without its secret columns. ``kind``: parquet, orc, json, csv or jdbc (with url and dbtable)."""
    df = spark.read.format(kind).options(**options).load(*([] if kind == "jdbc" else [path]))
    return df.drop(*(c for c in df.columns if c.lower() in SECRETS))


def lookup(df: DataFrame, key: str, value: object) -> DataFrame:
    """The row of a key."""
    return df.filter(F.col(key) == value).limit(1)


def fetch(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows whose key is among ``wanted``'s (one column of that name)."""
    return df.join(wanted, key, "left_semi")


def key_range(df: DataFrame, key: str, after: int, size: int) -> DataFrame:
    """The next ``size`` rows behind a key, in its order: one step of a scan in batches."""
    return df.filter(F.col(key) > after).orderBy(key).limit(size)


def insert_new(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows and those new ones whose keys aren't stored yet; of new rows with one key, one."""
    return stored.unionByName(new.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti"))


def add_counters(stored: DataFrame, delta: DataFrame, keys: list[str], counters: list[str]) -> DataFrame:
    """Counters of both sides added up by key: an upsert that adds."""
    both = stored.select(*keys, *counters).unionByName(delta.select(*keys, *counters))
    return both.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in counters))


def keep_since(df: DataFrame, at: str, cutoff: Column | int, days: int) -> DataFrame:
    """Rows not older than the cutoff; with days <= 0 nothing is old."""
    return df if days <= 0 else df.filter(F.col(at) >= cutoff)


def all_of(*tests: Column | None) -> Column:
    """The conjunction of those tests that are given."""
    return reduce(lambda a, b: a & b, [t for t in tests if t is not None], F.lit(True))


def page(df: DataFrame, order: list[Column], number: int = 1, size: int = 20) -> DataFrame:
    """One page; the number is at least 1, the size 20 if not positive and at most 100."""
    size = min(size if size > 0 else 20, 100)
    return df.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size)


def append(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Adds rows to a table, in the folders of the given columns."""
    writer = df.write.mode("append").option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def overwrite(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Writes a table anew, partitioned by the given columns."""
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)
