"""Channels, abilities, models and vendors: matching, routing and search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from meterlark.functions.scalars import contains, csv_items

EXACT, PREFIX, CONTAINS, SUFFIX = 0, 1, 2, 3
#: Rows of a dimension that may be broadcast; beyond it the join is left to the planner.
SMALL_ROWS = 50_000
#: Columns by which channels may be sorted.
SORTS = {"id", "name", "priority", "balance", "response_time", "test_time"}


def small(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """A dimension, marked for broadcast if it is counted to be small."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def match_names(names: DataFrame, meta: DataFrame) -> DataFrame:
    """(model_name, meta_id, vendor_id, name_rule): the rule of each name. Exact rules go first, then prefix, suffix and contains; within a kind the lowest id.

    All are equi-joins over distinct names: a name is looked up whole, by each of its beginnings and
    endings, and by each of its parts of a length that some rule has.
    """
    rule = meta.select(F.col("id").alias("meta_id"), F.col("model_name").alias("pattern"), "name_rule", "vendor_id", F.col("status").alias("meta_status"))
    unique = names.select("model_name").filter("model_name <> ''").distinct()
    known = rule.filter("pattern <> ''")
    lengths = F.coalesce(known.filter(F.col("name_rule") == CONTAINS).agg(F.collect_set(F.length("pattern"))).scalar(), F.array().cast("array<int>"))
    name, every = F.col("model_name"), F.sequence(F.lit(1), F.length("model_name"))
    part = lambda n: F.transform(F.sequence(F.lit(1), F.length("model_name") - n + 1), lambda i: F.substring(name, i, n))
    way = lambda kind, parts: F.struct(F.lit(kind).cast("long").alias("name_rule"), parts.alias("pattern"))
    looked = F.array(
        way(EXACT, F.array(name)),
        way(PREFIX, F.transform(every, lambda n: F.substring(name, F.lit(1), n))),
        way(SUFFIX, F.transform(every, lambda n: F.substring(name, n, F.length(name)))),
        way(CONTAINS, F.array_distinct(F.flatten(F.transform(F.filter("lengths", lambda n: n <= F.length(name)), part)))),
    )
    ways = unique.withColumn("lengths", lengths).select("model_name", F.explode(looked).alias("l")).select("model_name", "l.name_rule", F.explode("l.pattern").alias("pattern"))
    found = ways.join(known, ["name_rule", "pattern"])
    order = F.when(F.col("name_rule") == EXACT, 0).when(F.col("name_rule") == PREFIX, 1).when(F.col("name_rule") == SUFFIX, 2).otherwise(3)
    best = F.min_by(F.struct("meta_id", "vendor_id", "name_rule", "meta_status"), F.struct(order, F.col("meta_id")))
    return found.groupBy("model_name").agg(best.alias("m")).select("model_name", "m.*")


def vendor_names(names: DataFrame, meta: DataFrame, vendors: DataFrame) -> DataFrame:
    """(model_name, vendor): by the matched rule; Unknown where there is none or its vendor doesn't exist."""
    known = vendors.select(F.col("id").alias("vendor_id"), F.col("name").alias("vendor"))
    return match_names(names, meta).join(known, "vendor_id", "left").select("model_name", F.coalesce("vendor", F.lit("Unknown")).alias("vendor"))


def ability_channels(abilities: DataFrame, channels: DataFrame) -> DataFrame:
    """Enabled abilities with their channels; the channel's columns are null where it doesn't exist."""
    c = channels.select(F.col("id").alias("channel_id"), F.col("name").alias("channel_name"), F.col("type").alias("channel_type"), F.col("status").alias("channel_status"))
    return abilities.filter("enabled").join(c, "channel_id", "left")


def bound_channels(abilities: DataFrame, channels: DataFrame) -> DataFrame:
    """(model, channels, types): distinct channel names and types of each model, sorted."""
    c = channels.select(F.col("id").alias("channel_id"), F.col("name").alias("channel_name"), F.col("type").alias("channel_type"))
    pairs = abilities.filter("enabled").join(c, "channel_id").select("model", "channel_name", "channel_type").distinct()
    return pairs.groupBy("model").agg(F.array_sort(F.collect_set("channel_name")).alias("channels"), F.array_sort(F.collect_set("channel_type")).alias("types"))


def expand(channels: DataFrame) -> DataFrame:
    """(group_name, model, channel_id, enabled, tag): every model of every group of each channel, once."""
    models = channels.select("id", "status", "tag", "group_names", F.explode(csv_items(F.col("models"))).alias("model"))
    return models.select(F.explode(csv_items(F.col("group_names"))).alias("group_name"), "model", F.col("id").alias("channel_id"), (F.col("status") == 1).alias("enabled"), "tag").distinct()


def by_priority(abilities: DataFrame) -> DataFrame:
    """Enabled abilities with tier: 1 for the highest priority of their group and model; a null priority counts as 0."""
    rank = F.dense_rank().over(W.partitionBy("group_name", "model").orderBy(F.desc("_p")))
    return abilities.filter("enabled").withColumn("_p", F.coalesce("priority", F.lit(0))).withColumn("tier", rank.cast("long")).withColumn("priority", F.col("_p")).drop("_p")


def tier_of_retry(abilities: DataFrame, retry: int) -> DataFrame:
    """The abilities tried at a retry: the tier of that number, or the last one."""
    tiers = by_priority(abilities).withColumn("tiers", F.max("tier").over(W.partitionBy("group_name", "model")))
    return tiers.filter(F.col("tier") == F.least(F.lit(max(retry, 0) + 1), F.col("tiers")))


def probabilities(abilities: DataFrame) -> DataFrame:
    """Top tier with the chance of each channel: weight + 10 over the sum of these."""
    weight = F.coalesce("weight", F.lit(0)) + 10
    return tier_of_retry(abilities, 0).withColumn("probability", weight / F.sum(weight).over(W.partitionBy("group_name", "model")))


def pick(probable: DataFrame, draw: Column) -> DataFrame:
    """The channel of each group and model that a draw from [0, 1) falls on, going through channels by id."""
    upto = F.sum("probability").over(W.partitionBy("group_name", "model").orderBy("channel_id").rowsBetween(W.unboundedPreceding, 0))
    return probable.withColumn("upto", upto).filter(F.col("upto") > draw).groupBy("group_name", "model").agg(F.min_by("channel_id", "channel_id").alias("channel_id"))


def channel_search(channels: DataFrame, keyword: str = "", model: str = "") -> DataFrame:
    """Channels by id or part of their name, that list a model whose name has a part."""
    tests = [contains(F.col("name"), keyword)]
    if keyword.strip().isdigit():
        tests = [tests[0] | (F.col("id") == int(keyword))]
    for t in (*tests, contains(F.col("models"), model)):
        channels = channels.filter(t) if t is not None else channels
    return channels


def sorted_by(df: DataFrame, column: str, direction: str, by_id: bool = False) -> DataFrame:
    """By a permitted column, else by priority (id, where asked for or where there is none), the highest first; anything but asc is descending. Ties go by id, nulls last."""
    name, up = column.strip().lower(), direction.strip().lower() == "asc"
    if name not in SORTS or name not in df.columns:
        name, up = "priority" if "priority" in df.columns and not by_id else "id", False
    return df.orderBy(F.asc_nulls_last(name) if up else F.desc_nulls_last(name), F.desc("id"))


def missing_models(log: DataFrame, meta: DataFrame) -> DataFrame:
    """(model_name): used names that no rule matches."""
    used = log.select("model_name").filter("model_name <> ''").distinct()
    return used.join(match_names(used, meta).select("model_name"), "model_name", "left_anti")
