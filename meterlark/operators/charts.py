"""Chart series over a rollup: time by model, top-n with the rest, dense axes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from meterlark.functions.scalars import bucket

GRAINS = {"hour": 3600, "day": 86_400, "week": 604_800}


def label(at: Column, grain: str) -> Column:
    """Text of a bucket. Weeks are seven days from the bucket's start, which isn't a Monday in general."""
    t = F.timestamp_seconds(at)
    if grain == "hour":
        return F.date_format(t, "MM-dd HH:00")
    if grain == "week":
        return F.concat(F.date_format(t, "MM-dd"), F.lit(" - "), F.date_format(F.timestamp_seconds(at + 6 * 86_400), "MM-dd"))
    return F.date_format(t, "MM-dd")


def by_time(rolled: DataFrame, grain: str, column: str = "model_name") -> DataFrame:
    """(bucket, label, column, count, quota, token_used); blank and null names are Unknown."""
    name = F.when(F.coalesce(F.col(column), F.lit("")) == "", "Unknown").otherwise(F.col(column))
    sums = rolled.groupBy(bucket(F.col("hour"), GRAINS[grain]).alias("bucket"), name.alias(column)).agg(*(F.sum(c).alias(c) for c in ("count", "quota", "token_used")))
    return sums.withColumn("label", label(F.col("bucket"), grain))


def top_and_other(sums: DataFrame, column: str, measure: str, most: int, other: str = "Other") -> DataFrame:
    """(bucket, column, measure): the first ``most`` names by the measure's total (ties by name), the rest as one."""
    totals = sums.groupBy(column).agg(F.sum(measure).alias("_t"))
    first = totals.orderBy(F.desc("_t"), column).limit(most).select(column, F.lit(True).alias("_kept"))
    name = F.when(F.col("_kept"), F.col(column)).otherwise(F.lit(other))
    return sums.join(first, column, "left").groupBy("bucket", name.alias(column)).agg(F.sum(measure).alias(measure))


def dense(sums: DataFrame, column: str, measures: list[str], size: int) -> DataFrame:
    """Every name at every step of the time axis, 0 where there is nothing, with each step's sum of the first measure."""
    first, last = sums.agg(F.min("bucket")).scalar(), sums.agg(F.max("bucket")).scalar()
    axis = sums.select(column).distinct().select(column, F.explode(F.sequence(first, last, F.lit(size))).alias("bucket"))
    full = axis.join(sums.select("bucket", column, *measures), ["bucket", column], "left").na.fill(0, measures)
    return full.withColumn("time_sum", F.sum(measures[0]).over(W.partitionBy("bucket")))


def steps(sums: DataFrame, column: str, measure: str) -> DataFrame:
    """Every name at every step that any name has, 0 where there is nothing. Steps are as many as the chart's times, which are gathered in one row."""
    times = sums.agg(F.collect_set("bucket")).scalar()
    axis = sums.select(column).distinct().select(column, F.explode(times).alias("bucket"))
    return axis.join(sums.select("bucket", column, measure), ["bucket", column], "left").na.fill(0, [measure]).select("bucket", column, measure)


def padded(points: DataFrame, least: int, size: int) -> DataFrame:
    """A series (bucket, value) of at least ``least`` points: shorter ones become that many steps ending at the last point."""
    n, last = points.agg(F.count("*")).scalar(), points.agg(F.max("bucket")).scalar()
    start = F.least(points.agg(F.min("bucket")).scalar(), F.when(n < least, last - (least - 1) * size).otherwise(last))
    axis = points.agg(F.max("bucket").alias("_last")).filter("_last IS NOT NULL").select(F.explode(F.sequence(start, last, F.lit(size))).alias("bucket"))
    return axis.join(points, "bucket", "left").na.fill(0)
