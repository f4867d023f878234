"""Rankings by tokens over a period, against the period before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from meterlark.functions.scalars import bucket, growth, share

DAY = 86_400
#: Length and bucket of each period in seconds; a length of None means all time.
PERIODS: dict[str, tuple[int | None, int]] = {"today": (DAY, 3600), "week": (7 * DAY, DAY), "month": (30 * DAY, DAY), "year": (365 * DAY, 7 * DAY), "all": (None, 30 * DAY)}


def period(name: str) -> tuple[int | None, int]:
    if (name or "week") not in PERIODS:
        raise ValueError(f"no such period: {name}")
    return PERIODS[name or "week"]


def period_sums(consumed: DataFrame, now: Column, name: str) -> DataFrame:
    """(model_name, tokens, before): every named model's tokens of the period and of the one before it, whole hours, in one pass.

    Without a period before (all time) ``before`` is null.
    """
    length, _ = period(name)
    hour, used = bucket(F.col("created_at"), 3600), F.col("prompt_tokens") + F.col("completion_tokens")
    named = consumed.filter("model_name <> ''")
    if length is None:
        return named.groupBy("model_name").agg(F.sum(used).alias("tokens"), F.lit(None).cast("long").alias("before"))
    start = now - length
    within = named.filter((hour >= start - length) & (hour <= now))
    return within.groupBy("model_name").agg(F.sum(F.when(hour >= start, used)).alias("tokens"), F.sum(F.when(hour <= start - 1, used)).alias("before"))


def totals(rolled: DataFrame) -> DataFrame:
    """(model_name, tokens) of models with a name and tokens."""
    return rolled.filter("model_name <> ''").groupBy("model_name").agg(F.sum("token_used").alias("tokens")).filter("tokens > 0")


def _place(sums: DataFrame, name: str, tokens: str) -> Column:
    """Unique rank from 1 among those with tokens, by tokens, ties by name; null for the others. One row a name, so one partition is enough."""
    return F.when(F.col(tokens) > 0, F.row_number().over(W.orderBy(F.desc_nulls_last(tokens), name)).cast("long"))


def models(sums: DataFrame) -> DataFrame:
    """All models of the period: rank, previous_rank (null if new), tokens, share and growth in percent."""
    placed = sums.withColumn("rank", _place(sums, "model_name", "tokens")).withColumn("previous_rank", _place(sums, "model_name", "before")).filter("rank IS NOT NULL")
    return placed.select(
        "rank", "model_name", "tokens", "previous_rank",
        share(F.col("tokens"), F.sum("tokens").over(W.partitionBy())).alias("share"),
        growth(F.col("tokens"), F.when(F.col("before") > 0, F.col("before"))).alias("growth_pct"),
    )


def top(ranking: DataFrame, most: int = 20) -> DataFrame:
    return ranking.filter(F.col("rank") <= most)


def movers(ranking: DataFrame, up: bool, most: int = 6) -> DataFrame:
    """Models that rose (or fell) most; new ones and those at their old rank are no movers."""
    moved = ranking.withColumn("delta", F.col("previous_rank") - F.col("rank")).filter("delta > 0" if up else "delta < 0")
    order = [F.desc("delta"), F.desc("growth_pct"), F.col("model_name")] if up else [F.col("delta"), F.col("growth_pct"), F.col("model_name")]
    return moved.orderBy(*order).limit(most).select("model_name", "rank", "previous_rank", "delta", "growth_pct")


def vendors(sums: DataFrame, vendor_of: DataFrame) -> DataFrame:
    """Vendors by tokens, then name: tokens, number of models, top model, share and growth. ``vendor_of``: (model_name, vendor)."""
    known = sums.join(vendor_of, "model_name", "left").withColumn("vendor", F.coalesce("vendor", F.lit("Unknown")))
    used, was = F.when(F.col("tokens") > 0, F.col("tokens")), F.when(F.col("before") > 0, F.col("before"))
    by = known.groupBy("vendor").agg(F.sum(used).alias("tokens"), F.sum(was).alias("before"), F.count(used).alias("models"), F.min_by("model_name", F.when(used.isNotNull(), F.struct(-F.col("tokens"), "model_name"))).alias("top_model")).filter("tokens > 0")
    return by.select(_place(by, "vendor", "tokens").alias("rank"), "vendor", "tokens", "models", "top_model", share(F.col("tokens"), F.sum("tokens").over(W.partitionBy())).alias("share"), growth(F.col("tokens"), F.col("before")).alias("growth_pct"))


def history(rows: DataFrame, size: int, column: str, most: int) -> DataFrame:
    """(bucket, column, tokens): the sums by bucket of the first ``most`` values of a column, the rest as Others."""
    named = rows.filter(F.col(column) != "")
    first = named.groupBy(column).agg(F.sum("token_used").alias("tokens")).filter("tokens > 0").orderBy(F.desc("tokens"), column).limit(most).select(column, F.lit(True).alias("kept"))
    sums = named.groupBy(bucket(F.col("hour"), size).alias("bucket"), column).agg(F.sum("token_used").alias("tokens"))
    label = F.when(F.col("kept"), F.col(column)).otherwise(F.lit("Others"))
    return sums.join(first, column, "left").groupBy("bucket", label.alias(column)).agg(F.sum("tokens").alias("tokens")).filter("tokens > 0")


def bucket_shares(sums: DataFrame) -> DataFrame:
    """With share: of the bucket's tokens."""
    return sums.withColumn("share", share(F.col("tokens"), F.sum("tokens").over(W.partitionBy("bucket"))))
