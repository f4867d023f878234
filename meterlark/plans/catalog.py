"""Queries on channels, abilities, models and vendors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from meterlark.functions.scalars import csv_has, prefixed
from meterlark.operators import catalog as C
from meterlark.plans.rankings import MATCH
from meterlark.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _t(name: str):
    return lambda spark, sf_dir: table(spark, sf_dir, name)


_ability, _channel, _meta, _vendor, _log = map(_t, ("ability", "channel", "model_meta", "vendor", "usage_log"))
_CSV = "list_distinct([trim(x) FOR x IN string_split(coalesce({0}, ''), ',') IF trim(x) <> ''])"


@query("SELECT a.channel_id, a.group_name, a.model, c.name AS channel_name, c.type AS channel_type, c.status AS channel_status FROM ability a LEFT JOIN channel c ON a.channel_id = c.id WHERE a.enabled")
def ability_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.ability_channels(_ability(spark, sf_dir), _channel(spark, sf_dir)).select("channel_id", "group_name", "model", "channel_name", "channel_type", "channel_status")


@query("SELECT a.model, array_to_string(list_sort(list(DISTINCT c.name)), ',') AS channels, count(DISTINCT c.type) AS n_types FROM ability a JOIN channel c ON a.channel_id = c.id WHERE a.enabled GROUP BY a.model")
def bound_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.bound_channels(_ability(spark, sf_dir), _channel(spark, sf_dir)).select("model", F.array_join("channels", ",").alias("channels"), F.size("types").cast("long").alias("n_types"))


@query(f"SELECT model_name, meta_id, vendor_id, name_rule FROM ({MATCH})")
def name_rule_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.match_names(_log(spark, sf_dir), _meta(spark, sf_dir)).select("model_name", "meta_id", F.coalesce("vendor_id", F.lit(-1)).alias("vendor_id"), "name_rule")


@query(f"SELECT DISTINCT u.model_name FROM usage_log u WHERE u.model_name <> '' AND u.model_name NOT IN (SELECT model_name FROM ({MATCH}))")
def missing_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.missing_models(_log(spark, sf_dir), _meta(spark, sf_dir))


@query("SELECT m.id, m.model_name, v.name AS vendor FROM model_meta m JOIN vendor v ON m.vendor_id = v.id WHERE v.name LIKE '%Cloud%'")
def model_vendor_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vendor(spark, sf_dir).filter(F.contains("name", F.lit("Cloud"))).select(F.col("id").alias("vendor_id"), F.col("name").alias("vendor"))
    return _meta(spark, sf_dir).join(v, "vendor_id").select("id", "model_name", "vendor")


@query("SELECT vendor_id, count(*) AS n FROM model_meta WHERE vendor_id IS NOT NULL GROUP BY vendor_id")
def vendor_model_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _meta(spark, sf_dir).filter("vendor_id IS NOT NULL").groupBy("vendor_id").agg(F.count("*").alias("n"))


@query("SELECT type, count(*) AS n FROM channel GROUP BY type")
def count_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _channel(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n"))


@query("SELECT count(DISTINCT tag) AS n FROM channel WHERE tag IS NOT NULL AND tag <> ''")
def count_distinct_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _channel(spark, sf_dir).filter("tag <> ''").agg(F.count_distinct("tag").alias("n"))


@query("SELECT DISTINCT tag FROM channel WHERE tag <> ''")
def distinct_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _channel(spark, sf_dir).filter("tag <> ''").select("tag").distinct()


@query("SELECT DISTINCT model FROM ability WHERE enabled")
def enabled_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ability(spark, sf_dir).filter("enabled").select("model").distinct()


@query(f"SELECT id FROM channel WHERE list_contains({_CSV.format('group_names')}, 'vip')")
def csv_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _channel(spark, sf_dir).filter(csv_has(F.col("group_names"), "vip")).select("id")


@query("SELECT id, name FROM channel WHERE (name LIKE '%manual%' OR name LIKE '%1%') AND models LIKE '%mini%'")
def channel_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = C.channel_search(_channel(spark, sf_dir), "manual", "mini").unionByName(C.channel_search(_channel(spark, sf_dir), "1", "mini").filter(F.contains("name", F.lit("1"))))
    return found.select("id", "name").distinct()


@query("SELECT id, name, status FROM channel ORDER BY name ASC NULLS LAST, id DESC LIMIT 20")
def channel_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.sorted_by(_channel(spark, sf_dir), " Name", "ASC").limit(20).select("id", "name", "status")


@query("SELECT id, name, status FROM channel ORDER BY id DESC LIMIT 20")
def channel_page_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By a column that isn't permitted."""
    return C.sorted_by(_channel(spark, sf_dir), "type", "asc").limit(20).select("id", "name", "status")


@query("SELECT id, name FROM channel WHERE id = 17 OR name LIKE '17%'")
def channel_prefix_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _channel(spark, sf_dir).filter(prefixed(F.col("id"), F.col("name"), "17")).select("id", "name")


@query("SELECT id, name FROM channel WHERE name LIKE 'optional%'")
def channel_prefix_search_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _channel(spark, sf_dir).filter(prefixed(F.col("id"), F.col("name"), "optional")).select("id", "name")


@query(f"SELECT DISTINCT model_name FROM usage_log WHERE model_name <> '' AND model_name NOT IN (SELECT model_name FROM ({MATCH}) WHERE name_rule = 0)")
def missing_exact_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Used names without a rule of their own."""
    return C.missing_models(_log(spark, sf_dir), _meta(spark, sf_dir).filter(F.col("name_rule") == C.EXACT))


@query("SELECT model, list_sort(list(DISTINCT group_name))[1] AS first_group, array_to_string(list(group_name ORDER BY priority DESC NULLS LAST, channel_id, group_name), ',') AS in_order FROM ability WHERE enabled GROUP BY model")
def model_groups_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of each model in the order of their abilities' priority, repeats kept; the first in order of name."""
    rows = _ability(spark, sf_dir).filter("enabled")
    at = F.struct(-F.coalesce("priority", F.lit(-(2**62))), "channel_id", "group_name")
    return rows.groupBy("model").agg(F.min("group_name").alias("first_group"), F.array_join(F.transform(F.array_sort(F.collect_list(at)), lambda x: x["group_name"]), ",").alias("in_order"))


@query(f"SELECT DISTINCT g AS group_name, m AS model, id AS channel_id, status = 1 AS enabled, tag FROM (SELECT *, unnest({_CSV.format('group_names')}) AS g FROM (SELECT *, unnest({_CSV.format('models')}) AS m FROM channel))")
def ability_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.expand(_channel(spark, sf_dir))


_TIERS = "SELECT *, coalesce(priority, 0) AS p, dense_rank() OVER (PARTITION BY group_name, model ORDER BY coalesce(priority, 0) DESC) AS tier FROM ability WHERE enabled"


@query(f"SELECT group_name, model, channel_id, p AS priority FROM ({_TIERS}) WHERE tier = 1")
def top_priority_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.tier_of_retry(_ability(spark, sf_dir), 0).select("group_name", "model", "channel_id", "priority")


@query(f"SELECT group_name, model, channel_id, tier FROM (SELECT *, max(tier) OVER (PARTITION BY group_name, model) AS tiers FROM ({_TIERS})) WHERE tier = least(3, tiers)")
def priority_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.tier_of_retry(_ability(spark, sf_dir), 2).select("group_name", "model", "channel_id", "tier")


@query(f"SELECT group_name, model, channel_id, round((coalesce(weight, 0) + 10)::DOUBLE / sum(coalesce(weight, 0) + 10) OVER (PARTITION BY group_name, model), 9) AS probability FROM ({_TIERS}) WHERE tier = 1")
def routing_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.probabilities(_ability(spark, sf_dir)).select("group_name", "model", "channel_id", F.round("probability", 9).alias("probability"))


@query(f"""SELECT group_name, model, min(channel_id) AS channel_id FROM (SELECT group_name, model, channel_id, sum(coalesce(weight, 0) + 10) OVER (PARTITION BY group_name, model ORDER BY channel_id) AS upto, sum(coalesce(weight, 0) + 10) OVER (PARTITION BY group_name, model) AS whole FROM ({_TIERS}) WHERE tier = 1)
    WHERE upto > 0.37 * whole GROUP BY group_name, model""")
def routing_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The channel that a draw of 0.37 falls on."""
    return C.pick(C.probabilities(_ability(spark, sf_dir)), F.lit(0.37))
