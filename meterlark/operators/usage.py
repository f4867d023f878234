"""Request logs: search, statistics and the hourly rollup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from meterlark.functions.scalars import bucket, contains
from meterlark.sources import all_of

#: Kinds of log rows.
TOPUP, CONSUME, MANAGE, SYSTEM, ERROR, REFUND = 1, 2, 3, 4, 5, 6
ROLLUP_KEYS = ["user_id", "username", "model_name", "hour"]
COUNTERS = ["count", "quota", "token_used"]
#: Rows that a user's search counts at most.
COUNTED = 10_000
#: Longest span of a dashboard request, in seconds, and that of the public summary of a day.
LONGEST_SPAN = 2_592_000
LONGEST_DAY = 48 * 3600


def latest(df: DataFrame, at: str = "created_at") -> Column:
    """The last moment of a table, which stands for now: one number, as a scalar subquery."""
    return df.agg(F.max(at)).scalar()


def search(log: DataFrame, *, kind: int = 0, model: str = "", username: str = "", token: str = "", request_id: str = "", start: int = 0, end: int = 0, channel: int = 0, group: str = "", empty_only: bool = False, user: int = 0) -> DataFrame:
    """Log rows that pass every filter given; 0 and blank mean no filter, time bounds are inclusive."""
    return log.filter(
        all_of(
            F.col("type") == kind if kind else None,
            contains(F.col("model_name"), model),
            contains(F.col("username"), username),
            contains(F.col("token_name"), token),
            F.col("request_id") == request_id if request_id else None,
            F.col("created_at") >= start if start else None,
            F.col("created_at") <= end if end else None,
            F.col("channel_id") == channel if channel else None,
            F.col("group_name") == group if group else None,
            F.col("completion_tokens") == 0 if empty_only else None,
            F.col("user_id") == user if user else None,
        )
    )


def total(rows: DataFrame, most: int | None = None) -> DataFrame:
    """(total): the number of rows, counted up to ``most``."""
    return (rows.limit(most) if most is not None else rows).agg(F.count("*").alias("total"))


def stat(log: DataFrame, now: Column, start: int = 0, end: int = 0) -> DataFrame:
    """(quota, rpm, tpm) of consumption: quota over the range, rows and tokens over the last minute whatever the range. 0 where there is nothing."""
    inside = all_of(F.col("created_at") >= start if start else None, F.col("created_at") <= end if end else None)
    recent = F.col("created_at") >= now - 60
    return log.filter(F.col("type") == CONSUME).agg(
        F.coalesce(F.sum(F.when(inside, F.col("quota"))), F.lit(0)).alias("quota"),
        F.count_if(recent).alias("rpm"),
        F.coalesce(F.sum(F.when(recent, F.col("prompt_tokens") + F.col("completion_tokens"))), F.lit(0)).alias("tpm"),
    )


def deliveries(log: DataFrame) -> DataFrame:
    """(id, rows): the first delivered row of each request, of those the lowest id, and how many there are. Rows without a request id stand for themselves."""
    alone = F.when(F.col("request_id").isNull(), F.col("id"))
    first = F.min_by("id", F.struct(F.coalesce("ingested_at", F.lit("9999-01-01").cast("timestamp")), "id"))
    return log.groupBy("request_id", alone.alias("alone")).agg(first.alias("id"), F.count("*").alias("rows")).select("id", "rows")


def totals(log: DataFrame) -> DataFrame:
    """(count, quota, token_used) of consumption, 0 where there is none."""
    return log.filter(F.col("type") == CONSUME).agg(F.count("*").alias("count"), F.coalesce(F.sum("quota"), F.lit(0)).alias("quota"), F.coalesce(F.sum(F.col("prompt_tokens") + F.col("completion_tokens")), F.lit(0)).alias("token_used"))


def day_summary(rolled: DataFrame, start: Column, end: Column) -> DataFrame:
    """Counters of a rollup's hours from ``start`` to ``end``, of which 48 hours at most; an end before the start is the start."""
    last = F.least(F.greatest(start, end), start + LONGEST_DAY)
    return rolled.filter((F.col("hour") >= start) & (F.col("hour") <= last)).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTERS))


def cache_windows(used: DataFrame, keys: list[str], seconds: int) -> DataFrame:
    """Counters of cached tokens by key and window; a window ends where nothing was seen for ``seconds``.

    ``used`` has event_time, cached, prompt_tokens, completion_tokens and mode. (keys, first_at, last_at,
    total, hits, cached_tokens, prompt_tokens, completion_tokens, mode); the mode is ``mixed`` where
    modes differ. Works on streams too, given a watermark.
    """
    window = F.session_window("event_time", f"{seconds} seconds")
    return (
        used.groupBy(*keys, window.alias("w"))
        .agg(
            F.count("*").alias("total"),
            F.count_if(F.col("cached") > 0).alias("hits"),
            F.coalesce(F.sum("cached"), F.lit(0)).alias("cached_tokens"),
            F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("prompt_tokens"),
            F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("completion_tokens"),
            F.when(F.min("mode") == F.max("mode"), F.max("mode")).when(F.max("mode").isNotNull(), "mixed").alias("mode"),
        )
        .select(*keys, F.unix_timestamp("w.start").alias("first_at"), (F.unix_timestamp("w.end") - seconds).alias("last_at"), "total", "hits", "cached_tokens", "prompt_tokens", "completion_tokens", "mode")
    )


def rollup(log: DataFrame, size: int = 3600, keys: tuple[str, ...] = ("user_id", "username", "model_name")) -> DataFrame:
    """Consumption by user, name, model and hour, or fewer keys and hour: count, quota, token_used."""
    return (
        log.filter(F.col("type") == CONSUME)
        .groupBy(*keys, bucket(F.col("created_at"), size).alias("hour"))
        .agg(F.count("*").alias("count"), F.sum("quota").alias("quota"), F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("token_used"))
    )


def regroup(rolled: DataFrame, *keys: str) -> DataFrame:
    """A rollup summed over the keys that aren't named."""
    return rolled.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in COUNTERS))


def span(start: int, end: int) -> tuple[int, int]:
    """A dashboard's time range, checked."""
    if end - start > LONGEST_SPAN:
        raise ValueError("the time range is too long")
    return start, max(start, end)


def with_channel(log: DataFrame, channels: DataFrame) -> DataFrame:
    """Log rows with channel_name, blank for channels that don't exist."""
    names = channels.select(F.col("id").alias("channel_id"), F.col("name").alias("channel_name"))
    return log.join(names, "channel_id", "left").withColumn("channel_name", F.coalesce("channel_name", F.lit("")))


def check_ins(rows: DataFrame, key: str, at: str, amount: str, today: Column) -> DataFrame:
    """(key, total, amount, month_total, today): how often a key checked in and what it got, all time; how often in the month of ``today``, a day; and whether on it.

    Days are texts year-month-day, and the month is the texts from -01 to -31.
    """
    day = F.date_format(F.timestamp_seconds(at), "yyyy-MM-dd")
    month = F.date_format(today, "yyyy-MM")
    within = day.between(F.concat(month, F.lit("-01")), F.concat(month, F.lit("-31")))
    return rows.groupBy(key).agg(
        F.count("*").alias("total"),
        F.coalesce(F.sum(amount), F.lit(0)).alias("amount"),
        F.count_if(within).alias("month_total"),
        F.coalesce(F.bool_or(day == F.date_format(today, "yyyy-MM-dd")), F.lit(False)).alias("today"),
    )
