"""Queries on request logs and their rollup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from meterlark import sources
from meterlark.functions import scalars
from meterlark.operators import usage as U
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


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "usage_log")


ROLLUP = "SELECT user_id, username, model_name, created_at - created_at % 3600 AS hour, count(*) AS count, sum(quota)::BIGINT AS quota, sum(prompt_tokens + completion_tokens)::BIGINT AS token_used FROM usage_log WHERE type = 2 GROUP BY ALL"
NOW = "(SELECT max(created_at) FROM usage_log)"


@query(f"SELECT id, created_at, type, username, token_name, model_name, group_name, request_id, channel_id, quota FROM usage_log WHERE type = 2 AND model_name LIKE '%mini%' AND username LIKE '%a%' AND created_at >= {NOW} - 5184000 AND created_at <= {NOW} ORDER BY id DESC LIMIT 100")
def log_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = log(spark, sf_dir)
    found = U.search(df, kind=2, model="mini", username="a").filter((F.col("created_at") >= U.latest(df) - 5_184_000) & (F.col("created_at") <= U.latest(df)))
    return sources.page(found, [F.desc("id")], 1, 100).select("id", "created_at", "type", "username", "token_name", "model_name", "group_name", "request_id", "channel_id", "quota")


@query("SELECT count(*) AS total FROM usage_log WHERE type = 2 AND model_name LIKE '%mini%' AND username LIKE '%a%' AND group_name = 'vip'")
def log_search_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.total(U.search(log(spark, sf_dir), kind=2, model="mini", username="a", group="vip"))


@query("SELECT least(count(*), 10000) AS total FROM usage_log WHERE user_id = 1007")
def log_search_user_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.total(U.search(log(spark, sf_dir), user=1007), U.COUNTED)


@query("SELECT id, model_name, channel_id FROM usage_log WHERE type = 2 AND completion_tokens = 0")
def log_empty_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.search(log(spark, sf_dir), kind=2, empty_only=True).select("id", "model_name", "channel_id")


@query("SELECT id, content FROM usage_log WHERE content LIKE '%status!_code=4%' ESCAPE '!'")
def like_contains_escaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log(spark, sf_dir).filter(scalars.contains(F.col("content"), " status_code=4 ")).select("id", "content")


@query("SELECT token_name, count(*) AS n FROM usage_log WHERE token_name LIKE 'key-%' ESCAPE '!' GROUP BY token_name")
def token_guarded_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log(spark, sf_dir).filter(scalars.guarded_like(F.col("token_name"), "key-%")).groupBy("token_name").agg(F.count("*").alias("n"))


@query(f"""SELECT coalesce(sum(CASE WHEN created_at >= {NOW} - 604800 THEN quota END), 0)::BIGINT AS quota, count(*) FILTER (created_at >= {NOW} - 60) AS rpm,
    coalesce(sum(CASE WHEN created_at >= {NOW} - 60 THEN prompt_tokens + completion_tokens END), 0)::BIGINT AS tpm FROM usage_log WHERE type = 2""")
def log_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = log(spark, sf_dir)
    now = df.agg(F.max("created_at")).first()[0]
    return U.stat(df, F.lit(now), start=now - 604_800 if now else 0)


@query("SELECT (coalesce(sum(prompt_tokens), 0) + coalesce(sum(completion_tokens), 0))::BIGINT AS tokens FROM usage_log WHERE model_name = 'lumora-mini' AND group_name = 'default'")
def log_token_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = log(spark, sf_dir).filter((F.col("model_name") == "lumora-mini") & (F.col("group_name") == "default"))
    return own.agg((F.coalesce(F.sum("prompt_tokens"), F.lit(0)) + F.coalesce(F.sum("completion_tokens"), F.lit(0))).alias("tokens"))


@query("SELECT l.id, l.channel_id, coalesce(c.name, '') AS channel_name FROM usage_log l LEFT JOIN channel c ON l.channel_id = c.id")
def log_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.with_channel(log(spark, sf_dir), table(spark, sf_dir, "channel")).select("id", "channel_id", "channel_name")


@query("""SELECT id, CASE WHEN other IS NOT NULL AND json_valid(other) AND json_type(other) = 'OBJECT' THEN array_to_string(list_sort([x FOR x IN json_keys(other) IF x NOT IN ('admin_info', 'stream_status')]), ',') END AS members,
    CASE WHEN json_valid(other) THEN (other ->> '$.frt')::BIGINT END AS frt FROM usage_log""")
def log_user_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meterlark.functions.json_rules import without_keys

    view = log(spark, sf_dir).select("id", without_keys(F.col("other"), ["admin_info", "stream_status"]).alias("other"))
    return view.select("id", F.array_join(F.array_sort(F.json_object_keys("other")), ",").alias("members"), F.get_json_object("other", "$.frt").cast("long").alias("frt"))


@query("""SELECT row_number() OVER (ORDER BY id DESC)::BIGINT AS shown, id FROM usage_log WHERE user_id = 1007 ORDER BY id DESC LIMIT 100""")
def log_renumbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's page, whose rows are numbered from 1 in place of their ids."""
    from pyspark.sql import Window as W

    first = sources.page(U.search(log(spark, sf_dir), user=1007), [F.desc("id")], 1, 100)
    return first.select(F.row_number().over(W.orderBy(F.desc("id"))).cast("long").alias("shown"), "id")


@query("SELECT min(id) AS id, count(*) AS deliveries FROM (SELECT *, coalesce(request_id, '#' || id) AS k FROM usage_log) GROUP BY k HAVING count(*) > 1")
def log_redelivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.coalesce("request_id", F.concat(F.lit("#"), F.col("id").cast("string")))
    return log(spark, sf_dir).groupBy(key.alias("k")).agg(F.min("id").alias("id"), F.count("*").alias("deliveries")).filter("deliveries > 1").select("id", "deliveries")


@query("SELECT arg_min(id, (coalesce(ingested_at, TIMESTAMP '9999-01-01'), id)) AS id, count(*) AS rows FROM usage_log GROUP BY request_id, CASE WHEN request_id IS NULL THEN id END")
def log_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.deliveries(log(spark, sf_dir))


@query("""SELECT channel_id, count(*) AS n, count(*) FILTER (type = 2) AS consumed, count(*) FILTER (type = 5) AS failed, count(*) FILTER (is_stream) AS streamed, min(created_at) AS first_at, max(created_at) AS last_at FROM usage_log GROUP BY channel_id""")
def conditional_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log(spark, sf_dir).groupBy("channel_id").agg(F.count("*").alias("n"), F.count_if(F.col("type") == 2).alias("consumed"), F.count_if(F.col("type") == 5).alias("failed"), F.count_if("is_stream").alias("streamed"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))


@query(f"SELECT user_id, count(*) AS n FROM usage_log WHERE created_at >= {NOW} - 30 * 86400 GROUP BY user_id")
def retention_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = log(spark, sf_dir)
    return sources.keep_since(df, "created_at", U.latest(df) - 30 * 86_400, 30).groupBy("user_id").agg(F.count("*").alias("n"))


@query("SELECT u.id, u.request_id FROM usage_log u WHERE u.channel_id IN (SELECT id FROM channel WHERE tag = 'ap')")
def log_fetch_in_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "channel").filter("tag = 'ap'").select(F.col("id").alias("channel_id"))
    return sources.fetch(log(spark, sf_dir), "channel_id", wanted).select("id", "request_id")


@query(f"""WITH old AS (SELECT id, channel_id FROM usage_log WHERE created_at < {NOW} - 10 * 86400)
    SELECT channel_id, count(*) AS n, sum(id)::BIGINT AS ids FROM (SELECT * FROM old UNION ALL SELECT id, channel_id FROM usage_log WHERE id NOT IN (SELECT id FROM old)) GROUP BY channel_id""")
def batch_insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log up to a moment, into which the whole log is inserted where its keys are new."""
    df = log(spark, sf_dir)
    rows = df.select("id", "channel_id")
    stored = df.filter(F.col("created_at") < U.latest(df) - 10 * 86_400).select("id", "channel_id")
    return sources.insert_new(stored, rows, ["id"]).groupBy("channel_id").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query(ROLLUP)
def usage_hourly_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.rollup(log(spark, sf_dir))


@query(f"SELECT username, hour, sum(count)::BIGINT AS count, sum(quota)::BIGINT AS quota, sum(token_used)::BIGINT AS token_used FROM ({ROLLUP}) GROUP BY username, hour")
def usage_by_user_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.rollup(log(spark, sf_dir), keys=("username",))


@query(f"SELECT model_name, hour, sum(count)::BIGINT AS count, sum(quota)::BIGINT AS quota, sum(token_used)::BIGINT AS token_used FROM ({ROLLUP}) GROUP BY model_name, hour")
def usage_by_model_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.rollup(log(spark, sf_dir), keys=("model_name",))


@query("SELECT count(*) AS count, coalesce(sum(quota), 0)::BIGINT AS quota, coalesce(sum(prompt_tokens + completion_tokens), 0)::BIGINT AS token_used FROM usage_log WHERE type = 2 AND username = 'nobody at all'")
def usage_totals_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.totals(log(spark, sf_dir).filter("username = 'nobody at all'"))


@query("SELECT count(*) AS count, coalesce(sum(quota), 0)::BIGINT AS quota, coalesce(sum(prompt_tokens + completion_tokens), 0)::BIGINT AS token_used FROM usage_log WHERE type = 2")
def usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.totals(log(spark, sf_dir))


@query(f"SELECT coalesce(sum(count), 0)::BIGINT AS count, coalesce(sum(quota), 0)::BIGINT AS quota, coalesce(sum(token_used), 0)::BIGINT AS token_used FROM ({ROLLUP}) WHERE hour >= {NOW} - 20 * 86400 AND hour <= {NOW} - 18 * 86400")
def usage_day_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The public summary: asked for twenty days, it gives the first 48 hours."""
    df = log(spark, sf_dir)
    now = U.latest(df)
    return U.day_summary(U.rollup(df, keys=()), now - 20 * 86_400, now)


@query(f"""SELECT model_name, n, trunc(n * 1000.0::DOUBLE / minutes + 0.5) / 1000 AS rpm, trunc(tokens * 1000.0::DOUBLE / minutes + 0.5) / 1000 AS tpm FROM (
    SELECT model_name, count(*) AS n, sum(prompt_tokens + completion_tokens) AS tokens, greatest(1, ({NOW} % 86400) // 60) AS minutes FROM usage_log WHERE type = 2 AND created_at >= {NOW} - {NOW} % 86400 GROUP BY model_name)""")
def usage_rates_today(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests and tokens a minute since midnight, to three places."""
    df = log(spark, sf_dir)
    now = U.latest(df)
    today = df.filter((F.col("type") == U.CONSUME) & (F.col("created_at") >= now - now % 86_400))
    rate = lambda x: F.floor(x * 1000.0 / F.greatest(F.lit(1), F.floor(now % 86_400 / 60)) + 0.5) / 1000
    return today.groupBy("model_name").agg(F.count("*").alias("n"), F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("tokens")).select("model_name", "n", rate(F.col("n")).alias("rpm"), rate(F.col("tokens")).alias("tpm"))


@query(ROLLUP)
def usage_upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rollup up to a moment, to which the rollup of what came later is added."""
    df = log(spark, sf_dir)
    cut = U.latest(df) - 10 * 86_400
    stored, delta = U.rollup(df.filter(F.col("created_at") < cut)), U.rollup(df.filter(F.col("created_at") >= cut))
    return sources.add_counters(stored, delta, U.ROLLUP_KEYS, U.COUNTERS)


@query("""SELECT model_name, group_name, count(*) AS total, count(*) FILTER (c > 0) AS hits, coalesce(sum(c), 0)::BIGINT AS cached_tokens, sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(completion_tokens)::BIGINT AS completion_tokens,
    CASE WHEN count(DISTINCT is_stream) > 1 THEN 'mixed' WHEN bool_or(is_stream) THEN 'stream' ELSE 'plain' END AS mode
    FROM (SELECT *, CASE WHEN json_valid(other) THEN (other ->> '$.cache_tokens')::BIGINT END AS c FROM usage_log WHERE type = 2) GROUP BY model_name, group_name""")
def cache_hit_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    cached = F.try_variant_get(F.try_parse_json("other"), "$.cache_tokens", "long")
    used = log(spark, sf_dir).filter("type = 2").withColumn("c", cached)
    mode = F.when(F.count_distinct("is_stream") > 1, "mixed").when(F.max("is_stream"), "stream").otherwise("plain")
    return used.groupBy("model_name", "group_name").agg(F.count("*").alias("total"), F.count_if(F.col("c") > 0).alias("hits"), F.coalesce(F.sum("c"), F.lit(0)).alias("cached_tokens"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), mode.alias("mode"))


_CACHED = "SELECT *, CASE WHEN json_valid(other) THEN (other ->> '$.cache_tokens')::BIGINT END AS c, CASE WHEN is_stream THEN 'stream' WHEN NOT is_stream THEN 'plain' END AS m FROM usage_log WHERE type = 2 AND created_at IS NOT NULL"
CACHE_WINDOWS = f"""SELECT model_name, group_name, min(created_at) AS first_at, max(created_at) AS last_at, count(*) AS total, count(*) FILTER (c > 0) AS hits, coalesce(sum(c), 0)::BIGINT AS cached_tokens, coalesce(sum(prompt_tokens), 0)::BIGINT AS prompt_tokens,
    coalesce(sum(completion_tokens), 0)::BIGINT AS completion_tokens, CASE WHEN count(DISTINCT m) > 1 THEN 'mixed' ELSE max(m) END AS mode
    FROM (SELECT *, sum(CASE WHEN created_at - before > 3600 THEN 1 ELSE 0 END) OVER (PARTITION BY model_name, group_name ORDER BY created_at, id) AS w FROM (SELECT *, lag(created_at) OVER (PARTITION BY model_name, group_name ORDER BY created_at, id) AS before FROM ({_CACHED})))
    GROUP BY model_name, group_name, w"""


def cached_use(rows: DataFrame) -> DataFrame:
    """Consumption with its cached tokens and mode."""
    cached = F.try_variant_get(F.try_parse_json("other"), "$.cache_tokens", "long")
    return rows.filter("type = 2 AND created_at IS NOT NULL").withColumn("cached", cached).withColumn("mode", F.when(F.col("is_stream"), "stream").when(~F.col("is_stream"), "plain"))


@query(CACHE_WINDOWS)
def cache_hit_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of cached tokens; an hour without use ends a window."""
    used = cached_use(log(spark, sf_dir)).withColumn("event_time", F.timestamp_seconds("created_at"))
    return U.cache_windows(used, ["model_name", "group_name"], 3600)


@query("SELECT id, sha256(coalesce(request_id, '') || '|' || id) AS digest FROM usage_log")
def log_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log(spark, sf_dir).select("id", scalars.digest(F.concat(F.coalesce("request_id", F.lit("")), F.lit("|"), F.col("id").cast("string"))).alias("digest"))


@query("SELECT id, quota / 500000.0::DOUBLE AS usd, quota / 500000.0::DOUBLE * 7.3 AS cny, quota::DOUBLE AS tokens FROM usage_log")
def quota_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quota as it is shown: in dollars, in another currency, or as it is."""
    q = F.col("quota")
    return log(spark, sf_dir).select("id", scalars.shown(q, "USD").alias("usd"), scalars.shown(q, "CNY", rate=7.3).alias("cny"), scalars.shown(q, "TOKENS").alias("tokens"))


@query("SELECT channel_id, CASE WHEN count(*) FILTER (type = 2) > 0 THEN round(count(*) FILTER (type = 5) / count(*) FILTER (type = 2)::DOUBLE * 1000.0) / 1000.0 ELSE 0.0::DOUBLE END AS failures FROM usage_log GROUP BY channel_id")
def failure_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed requests for each one served, to three places; 0 where none was."""
    n = log(spark, sf_dir).groupBy("channel_id").agg(F.count_if(F.col("type") == 5).alias("failed"), F.count_if(F.col("type") == 2).alias("served"))
    return n.select("channel_id", scalars.divided(F.col("failed"), F.col("served")).alias("failures"))


@query("SELECT id, request_id, model_name FROM usage_log WHERE id = 17")
def log_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.lookup(log(spark, sf_dir), "id", 17).select("id", "request_id", "model_name")


@query("SELECT id, channel_id FROM usage_log WHERE id > 250 ORDER BY id LIMIT 200")
def log_key_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One step of a scan in batches by key."""
    return sources.key_range(log(spark, sf_dir), "id", 250, 200).select("id", "channel_id")


@query("SELECT id, created_at FROM usage_log ORDER BY id DESC LIMIT 100 OFFSET 200")
def log_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page, for which a thousand rows were asked and a hundred are given."""
    return sources.page(log(spark, sf_dir), [F.desc("id")], 3, 1000).select("id", "created_at")


@query(f"SELECT user_id, count(*) AS n FROM usage_log WHERE created_at >= {NOW} - 2592000 AND created_at <= {NOW} GROUP BY user_id")
def log_longest_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest range that a dashboard may ask for."""
    df = log(spark, sf_dir)
    last = df.agg(F.max("created_at")).first()[0] or 0
    start, end = U.span(last - U.LONGEST_SPAN, last)
    return df.filter((F.col("created_at") >= start) & (F.col("created_at") <= end)).groupBy("user_id").agg(F.count("*").alias("n"))


@query(f"""WITH d AS (SELECT user_id, quota, strftime(make_timestamp(created_at * 1000000), '%Y-%m-%d') AS day FROM usage_log WHERE type = 1), t AS (SELECT strftime(make_timestamp({NOW} * 1000000), '%Y-%m-%d') AS day)
    SELECT user_id, count(*) AS total, coalesce(sum(quota), 0)::BIGINT AS amount, count(*) FILTER (d.day >= t.day[:7] || '-01' AND d.day <= t.day[:7] || '-31') AS month_total, coalesce(bool_or(d.day = t.day), false) AS today FROM d, t GROUP BY user_id""")
def check_in_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one kind stand for check-ins."""
    df = log(spark, sf_dir)
    return U.check_ins(df.filter(F.col("type") == U.TOPUP), "user_id", "created_at", "quota", F.timestamp_seconds(U.latest(df)))
