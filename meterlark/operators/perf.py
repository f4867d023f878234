"""Performance samples: rollup, summaries, series and the status board."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from meterlark.functions.scalars import away, bucket

COUNTERS = ["request_count", "success_count", "total_latency_ms", "ttft_sum_ms", "ttft_count", "output_tokens", "generation_ms"]
KEYS = ["model_name", "group_name", "bucket"]


def rollup(samples: DataFrame, size: int = 3600, at: Column | None = None) -> DataFrame:
    """Samples by model, group and bucket. Blank models go, blank groups are ``default``, negative latencies are 0. ``at``: the bucket, if another column tells it."""
    one = lambda test, value: F.sum(F.when(test, value).otherwise(F.lit(0)))
    latency = F.greatest(F.coalesce("latency_ms", F.lit(0)), F.lit(0))
    generating = (F.col("output_tokens") > 0) & (F.col("generation_ms") > 0)
    streamed = F.coalesce("has_ttft", F.lit(False))
    return (
        samples.filter(F.trim("model") != "")
        .groupBy(F.col("model").alias("model_name"), F.when(F.trim(F.coalesce("group_name", F.lit(""))) == "", "default").otherwise(F.col("group_name")).alias("group_name"), (bucket(F.col("created_at"), size) if at is None else at).alias("bucket"))
        .agg(
            F.count("*").alias("request_count"),
            F.count_if(F.col("success")).alias("success_count"),
            F.sum(latency).alias("total_latency_ms"),
            one(streamed & (F.col("ttft_ms") > 0), F.col("ttft_ms")).alias("ttft_sum_ms"),
            one(streamed & (F.col("ttft_ms") > 0), F.lit(1)).alias("ttft_count"),
            one(generating, F.col("output_tokens")).alias("output_tokens"),
            one(generating, F.col("generation_ms")).alias("generation_ms"),
        )
    )


def sums(rolled: DataFrame, *keys: str) -> DataFrame:
    return rolled.filter("request_count > 0").groupBy(*keys).agg(*(F.sum(c).alias(c) for c in COUNTERS))


def average_latency() -> Column:
    """In whole milliseconds; 0 without requests."""
    return F.when(F.col("request_count") > 0, F.expr("total_latency_ms div request_count")).otherwise(F.lit(0)).cast("long")


def average_ttft() -> Column:
    return F.when(F.col("ttft_count") > 0, F.expr("ttft_sum_ms div ttft_count")).otherwise(F.lit(0)).cast("long")


def success_rate() -> Column:
    """In percent, not rounded; 0 without requests."""
    return F.when(F.col("request_count") > 0, F.col("success_count") * 100.0 / F.col("request_count")).otherwise(F.lit(0.0))


def tokens_per_second() -> Column:
    return F.when((F.col("generation_ms") > 0) & (F.col("output_tokens") > 0), F.col("output_tokens") * 1000.0 / F.col("generation_ms")).otherwise(F.lit(0.0))


def measures() -> list[Column]:
    return [average_latency().alias("avg_latency_ms"), average_ttft().alias("avg_ttft_ms"), away(success_rate(), 2).alias("success_rate"), away(tokens_per_second(), 2).alias("tps")]


def colour(rate: Column, requests: Column) -> Column:
    """empty, green from 95 percent, yellow from 80, else red; by the rate before rounding."""
    return F.when(requests <= 0, "empty").when(rate >= 95, "green").when(rate >= 80, "yellow").otherwise("red")


def summary(rolled: DataFrame) -> DataFrame:
    """Every model's measures."""
    return sums(rolled, "model_name").select("model_name", "request_count", *measures())


def series(rolled: DataFrame, model: str, group: str = "") -> DataFrame:
    """One model: a row for each group with its totals and its ordered series of buckets, of which ``recent`` leaves 720 hours at most."""
    own = rolled.filter(F.col("model_name") == model)
    if group:
        own = own.filter(F.col("group_name") == group)
    point = F.struct("bucket", "request_count", *measures())
    by_group = sums(own, "group_name", "bucket").groupBy("group_name").agg(*(F.sum(c).alias(c) for c in COUNTERS), F.array_sort(F.collect_list(point)).alias("series"))
    return by_group.select("group_name", "request_count", *measures(), "series")


def hours(asked: int) -> int:
    """Hours that a series covers: 24 by default, 720 at most."""
    return 24 if asked <= 0 else min(asked, 720)


def recent(rolled: DataFrame, now: Column, asked: int = 0) -> DataFrame:
    """Buckets that begin within the last hours, see ``hours``."""
    return rolled.filter((F.col("bucket") >= now - hours(asked) * 3600) & (F.col("bucket") <= now))


def board(rolled: DataFrame, now: Column, asked: int = 0, size: int = 3600) -> DataFrame:
    """The slots of the last hours (see ``hours``) of every model that has requests in them; those without requests are empty.

    Slots go from the bucket that holds the first moment, of which only what begins within the hours
    counts, to the present one. A model's slots are made from these two ends, so the dense board
    needs no join of all models with all buckets.
    """
    merged = sums(recent(rolled, now, asked), "model_name", "bucket")
    first, last = bucket(now - hours(asked) * 3600, size), bucket(now, size)
    slots = merged.select("model_name").distinct().select("model_name", F.explode(F.sequence(first, last, F.lit(size))).alias("bucket"))
    dense = slots.join(merged, ["model_name", "bucket"], "left").na.fill(0, COUNTERS)
    return dense.select("model_name", "bucket", "request_count", *measures(), colour(success_rate(), F.col("request_count")).alias("colour"))


def board_order(slots: DataFrame) -> DataFrame:
    """(model_name, colour, request_count, place): models by the colour of their sum, red first, then by requests."""
    order = F.when(F.col("colour") == "red", 0).when(F.col("colour") == "yellow", 1).when(F.col("colour") == "green", 2).otherwise(3)
    return slots.withColumn("place", order.cast("long"))
