"""Queries on scalar functions: JSON rules and edits, masks, status ranges, estimates, formulas, limiters, streams, nested records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from meterlark.functions import formula, json_rules as J, scalars as S
from meterlark.operators import limits, nested, usage as U
from meterlark.plans.perf import ROLLUP as PERF_ROLLUP
from meterlark.plans.usage import CACHE_WINDOWS, cached_use
from meterlark.session import table
from meterlark.streaming import rollups

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "usage_log")


_DOC = "CASE WHEN json_valid(other) THEN other END"


@query(f"SELECT id FROM (SELECT id, {_DOC} AS d FROM usage_log) WHERE (d ->> '$.model_ratio')::DOUBLE > 10 OR (d ->> '$.stream_status.end_reason') LIKE 'don%'")
def json_rule_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    conditions = [{"path": "model_ratio", "mode": "gt", "value": 10}, {"path": "stream_status.end_reason", "mode": "prefix", "value": "don"}]
    return _log(spark, sf_dir).filter(J.rules(F.col("other"), conditions)).select("id")


@query(f"SELECT id FROM (SELECT id, {_DOC} AS d FROM usage_log) WHERE (d ->> '$.group_ratio')::DOUBLE = 1 AND ((d -> '$.admin_info.use_channel[0]') IS NULL OR NOT contains((d ->> '$.admin_info.use_channel[0]'), '7'))")
def json_rule_filter_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    conditions = [{"path": "group_ratio", "mode": "full", "value": 1}, {"path": "admin_info.use_channel.0", "mode": "contains", "value": "7", "invert": True, "pass_missing_key": True}]
    return _log(spark, sf_dir).filter(J.rules(F.col("other"), conditions, "AND")).select("id")


@query(f"SELECT id, (d ->> '$.model_ratio')::DOUBLE AS ratio, TRUE AS admin_gone FROM (SELECT id, {_DOC} AS d FROM usage_log) WHERE d IS NOT NULL")
def json_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A member moved, one removed and one set, in Arrow batches."""
    operations = [{"mode": "move", "from": "model_ratio", "to": "ratio.model"}, {"mode": "delete", "path": "admin_info"}, {"mode": "set", "path": "seen", "value": True}]
    rows = _log(spark, sf_dir).filter(F.try_parse_json("other").isNotNull()).select("id", F.try_parse_json(J.edited(F.col("other"), operations)).alias("d"))
    return rows.select("id", F.try_variant_get("d", "$.ratio.model", "double").alias("ratio"), F.try_variant_get("d", "$.admin_info", "variant").isNull().alias("admin_gone"))


@query("SELECT message_id, CASE WHEN contains(coalesce(body, ''), '@') THEN '***@' || substr(body, strpos(body, '@') + 1) ELSE '***masked***' END AS masked FROM support_message")
def mask_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "support_message").select("message_id", S.mask_email(F.col("body")).alias("masked"))


@query(r"SELECT message_id, regexp_replace(body, '\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b', '***.***.***.***', 'g') AS masked FROM support_message WHERE body IS NOT NULL")
def mask_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "support_message").filter("body IS NOT NULL").select("message_id", S.mask_ip(F.col("body")).alias("masked"))


@query(r"SELECT message_id, regexp_replace(body, '(^|[\s\S]*?)(https?://[^\s/$.?#][^\s]+|$)', '\1', 'g') AS between, len(regexp_extract_all(body, 'https?://[^\s/$.?#][^\s]+')) AS urls FROM support_message WHERE body IS NOT NULL")
def mask_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands between URLs is as it was, and there are as many as before."""
    rows = table(spark, sf_dir, "support_message").filter("body IS NOT NULL").select("message_id", S.mask_url(F.col("body")).alias("m"))
    url = r"https?://\*\*\*[^\s]*"
    return rows.select("message_id", F.regexp_replace("m", url, "").alias("between"), F.regexp_count("m", F.lit(url)).cast("long").alias("urls"))


@query(r"SELECT host, CASE WHEN regexp_matches(host, '\.[^.]{0,3}\.[^.]{2}$') THEN repeat('***.', greatest(len(string_split(host, '.')) - 2, 1)) || regexp_extract(host, '[^.]*\.[^.]*$') ELSE repeat('***.', len(string_split(host, '.')) - 1) || regexp_extract(host, '[^.]*$') END AS masked FROM (SELECT DISTINCT regexp_extract(body, '@([a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,})', 1) AS host FROM support_message WHERE body IS NOT NULL) WHERE host <> ''")
def mask_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each name of a host that an at-sign in a message leads to, and as it is masked."""
    host = F.regexp_extract("body", r"@([a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,})", 1)
    found = table(spark, sf_dir, "support_message").filter("body IS NOT NULL").select(host.alias("host")).filter("host <> ''").distinct()
    return found.select("host", S.mask_domain(F.col("host")).alias("masked"))


@query("SELECT message_id, regexp_replace(body, '(.*)', '\\1') || ' ***.***.***.*** api_key:***' AS masked FROM support_message WHERE body IS NOT NULL AND NOT regexp_matches(body, '\\.[a-zA-Z0-9]|://|api_key')")
def mask_sensitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages without anything to mask, to which an address and a key are added."""
    rows = table(spark, sf_dir, "support_message").filter(F.col("body").isNotNull() & ~F.col("body").rlike(r"\.[a-zA-Z0-9]|://|api_key"))
    return rows.select("message_id", S.mask_sensitive(F.concat("body", F.lit(" 10.20.30.40 api_key:Zx81kq"))).alias("masked"))


@query(r"SELECT id, regexp_extract(content, 'status_code=(\d+)', 1)::BIGINT AS code FROM usage_log WHERE regexp_matches(content, 'status_code=\d+') AND (regexp_extract(content, 'status_code=(\d+)', 1)::BIGINT BETWEEN 400 AND 449 OR regexp_extract(content, 'status_code=(\d+)', 1)::BIGINT = 503)")
def status_range_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.expr(r"try_cast(regexp_extract(content, 'status_code=(\\d+)', 1) AS BIGINT)")
    return _log(spark, sf_dir).withColumn("code", code).filter(S.in_status_ranges(F.col("code"), "400-420, 503, 421-449, 410-430")).select("id", "code")


@query(f"SELECT id FROM (SELECT id, {_DOC} AS d FROM usage_log) WHERE d IS NOT NULL AND json_type(d -> '$.admin_info.use_channel') = 'ARRAY' AND (d ->> '$.admin_info.use_channel[#-1]') LIKE '%7'")
def json_rule_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the last item of a list."""
    return _log(spark, sf_dir).filter(J.rules(F.col("other"), [{"path": "admin_info.use_channel.-1", "mode": "suffix", "value": "7"}])).select("id")


@query(f"SELECT id FROM (SELECT id, {_DOC} AS d FROM usage_log) WHERE (d ->> '$.frt')::DOUBLE >= 500 AND (d ->> '$.frt')::DOUBLE < 1500 AND (d ->> '$.group_ratio')::DOUBLE <= 1")
def json_rule_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    conditions = [{"path": "frt", "mode": "gte", "value": 500}, {"path": "frt", "mode": "lt", "value": 1500}, {"path": "group_ratio", "mode": "lte", "value": 1}]
    return _log(spark, sf_dir).filter(J.rules(F.col("other"), conditions, "AND")).select("id")


@query(f"SELECT id, upper(e) || '!' AS reason, 'v-' || e AS marked, replace(e, 'o', '0') AS replaced, regexp_replace(e, '[aeiou]+', '_', 'g') AS vowels FROM (SELECT id, d ->> '$.stream_status.end_reason' AS e, json_type(d -> '$.stream_status.end_reason') AS kind FROM (SELECT id, {_DOC} AS d FROM usage_log)) WHERE kind = 'VARCHAR'")
def json_edit_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of a string, each edited in its own way."""
    at, copies = "stream_status.end_reason", ("a", "b", "c", "d")
    operations = [{"mode": "copy", "from": at, "to": c} for c in copies]
    operations += [{"mode": "to_upper", "path": "a"}, {"mode": "append", "path": "a", "value": "!"}, {"mode": "ensure_prefix", "path": "b", "value": "v-"}, {"mode": "ensure_prefix", "path": "b", "value": "v-"}, {"mode": "replace", "path": "c", "from": "o", "to": "0"}, {"mode": "regex_replace", "path": "d", "pattern": "[aeiou]+", "to": "_"}]
    rows = _log(spark, sf_dir).filter(F.schema_of_variant(F.try_variant_get(F.try_parse_json("other"), "$.stream_status.end_reason", "variant")) == "STRING")
    rows = rows.select("id", F.try_parse_json(J.edited(F.col("other"), operations)).alias("d"))
    return rows.select("id", *(F.try_variant_get("d", f"$.{c}", "string").alias(n) for c, n in zip(copies, ("reason", "marked", "replaced", "vowels"))))


@query("""SELECT user_id, make_timestamp(t * 1000000) + INTERVAL 3 DAY AS days, make_timestamp((t + 5000) * 1000000) AS own, CASE WHEN date_trunc('day', make_timestamp(t * 1000000)) + INTERVAL 1 DAY <= make_timestamp((t + 43200) * 1000000) THEN date_trunc('day', make_timestamp(t * 1000000)) + INTERVAL 1 DAY END AS midnight FROM (SELECT user_id, min(created_at) AS t FROM usage_log GROUP BY user_id)""")
def plan_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three days and 5,000 seconds on from every user's first moment, and the next midnight if it comes within twelve hours."""
    first = _log(spark, sf_dir).groupBy("user_id").agg(F.timestamp_seconds(F.min("created_at")).alias("t"))
    half_day = F.timestamp_seconds(F.unix_timestamp("t") + 43_200)
    return first.select("user_id", S.plan_end(F.col("t"), "day", 3).cast("timestamp_ntz").alias("days"), S.next_reset(F.col("t"), "custom", 5000).cast("timestamp_ntz").alias("own"), S.next_reset(F.col("t"), "daily", end=half_day).cast("timestamp_ntz").alias("midnight"))


_SPENT = "type = 1 OR type = 3 OR (type = 2 AND use_time <> 0 AND created_at + use_time * 86400 < (SELECT max(created_at) FROM usage_log))"


@query(f"SELECT id FROM usage_log WHERE {_SPENT}")
def spent_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test for codes that are used up, on log rows whose kind stands for the status and that run out some days later."""
    df = _log(spark, sf_dir)
    now = df.agg(F.max("created_at")).scalar()
    expires = F.when(F.col("use_time") == 0, F.lit(0)).otherwise(F.col("created_at") + F.col("use_time") * 86_400)
    return df.filter(S.spent(F.col("type"), expires, now, (1, 3), 2)).select("id")


@query(f"SELECT id, CASE WHEN (d ->> '$.model_ratio') IS NOT NULL AND contains(d ->> '$.model_ratio', '5') THEN 'five' WHEN username = 'nobody' THEN 'nobody' ELSE 'other' END AS tier FROM (SELECT id, coalesce(username, '') AS username, {_DOC} AS d FROM usage_log)")
def formula_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An expression that looks into a JSON body and at a header."""
    scope = formula.Scope({}, body=F.col("other"), headers=F.create_map(F.lit("x-user"), F.coalesce("username", F.lit(""))))
    _, tier = formula.compile_columns('has(param("model_ratio"), "5") ? tier("five", 1) : header(" X-User ") == "nobody" ? tier("nobody", 2) : tier("other", 3)', scope)
    return _log(spark, sf_dir).select("id", tier.alias("tier"))


def _estimate(text: str) -> str:
    """The estimate in SQL: signs of each class are counted and taken out in turn, letters and digits by their runs."""
    classes = [  # with their weight in hundredths
        ("[\\n\\t]", 50), ("[\\x{0B}-\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]", 42), ("[\\p{Han}\\x{3040}-\\x{30FF}\\x{AC00}-\\x{D7A3}]", 85), ("[\\x{2600}-\\x{27BF}\\x{1F300}-\\x{1F9FF}\\x{1FA00}-\\x{1FAFF}]", 212),
    ]
    others = [("[\\x{2200}-\\x{22FF}\\x{2A00}-\\x{2AFF}\\x{1D400}-\\x{1D7FF}±×÷¬°′″‴⁺⁻⁼⁽⁾₊₋₌₍₎]", 268), ("@", 200), ("[/:?&=;#%]", 100)]
    every = "|".join(c for c, _ in classes)
    rest = f"regexp_replace({text}, '{every}', chr(1), 'g')"  # a sign that parts runs, is of no class and is taken out below
    plain = f"regexp_replace({rest}, '\\pL|\\pN|\\x01', '', 'g')"
    count = lambda where, c: f"(length({where}) - length(regexp_replace({where}, '{c}', '', 'g')))"
    parts = [f"{count(text, c)} * {w}" for c, w in classes] + [f"len(regexp_extract_all({rest}, '{c}+')) * {w}" for c, w in (("\\pL", 102), ("\\pN", 155))] + [f"{count(plain, c)} * {w - 40}" for c, w in others] + [f"length({plain}) * 40"]
    return f"coalesce(ceil(({' + '.join(parts)}) / 100.0), 0)::BIGINT"


@query(f"SELECT doc_id, {_estimate('text')} AS tokens FROM documents")
def estimate_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", S.estimate_tokens(F.col("text")).alias("tokens"))


@query("""SELECT id, CASE WHEN prompt_tokens <= 2000 THEN prompt_tokens * 2.5::DOUBLE + completion_tokens * 10.0 ELSE greatest(prompt_tokens * 4.0::DOUBLE, 9000.0) + completion_tokens * 20.0 END AS value,
    CASE WHEN prompt_tokens <= 2000 THEN 'base' ELSE 'long' END AS tier FROM usage_log WHERE prompt_tokens IS NOT NULL AND completion_tokens IS NOT NULL""")
def tier_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An expression of two tiers as one column."""
    rows = _log(spark, sf_dir).filter("prompt_tokens IS NOT NULL AND completion_tokens IS NOT NULL")
    value, tier = formula.compile_columns('v1:p <= 2000 ? tier("base", p * 2.5 + c * 10) : tier("long", max(p * 4, 9000) + c * 20)', formula.Scope({"p": F.col("prompt_tokens"), "c": F.col("completion_tokens")}))
    return rows.select("id", value.alias("value"), tier.alias("tier"))


@query("SELECT id, CASE WHEN extract(hour FROM make_timestamp(created_at * 1000000)) >= 8 AND extract(dow FROM make_timestamp(created_at * 1000000)) NOT IN (0, 6) THEN 'day' ELSE 'off' END AS tier FROM usage_log")
def formula_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, tier = formula.compile_columns('hour("UTC") >= 8 && weekday("") != 0 && weekday("") != 6 ? tier("day", 1) : tier("off", 0)', formula.Scope({}, now=F.timestamp_seconds("created_at")))
    return _log(spark, sf_dir).select("id", tier.alias("tier"))


@query("""SELECT user_id, (make_date(year(f), month(f), 1) + (day(t) - 1)::INTEGER)::DATE AS plus_month, (date_trunc('week', t) + INTERVAL 7 DAY)::DATE AS next_week FROM (
    SELECT user_id, t, (date_trunc('month', t) + INTERVAL 1 MONTH)::DATE AS f FROM (SELECT user_id, make_timestamp(min(created_at) * 1000000) AS t FROM usage_log GROUP BY user_id))""")
def calendar_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A month on, running over, and the next Monday, of every user's first day."""
    first = _log(spark, sf_dir).groupBy("user_id").agg(F.timestamp_seconds(F.min("created_at")).alias("t"))
    return first.select("user_id", S.add_months(F.to_date("t"), 1).alias("plus_month"), F.to_date(S.next_reset(F.col("t"), "weekly")).alias("next_week"))


def _in_turn(first: str, following: str, state: str) -> str:
    """A limiter as a recursive query: a user's requests in order, one a round, with the limiter's state."""
    return f"""WITH RECURSIVE r AS (SELECT user_id, created_at, id, type, row_number() OVER (PARTITION BY user_id ORDER BY created_at, id) AS n FROM usage_log WHERE created_at IS NOT NULL),
        s AS (SELECT user_id, created_at, id, n, {first} FROM r WHERE n = 1 UNION ALL SELECT r.user_id, r.created_at, r.id, r.n, {following} FROM (SELECT *, {state} FROM s) s JOIN r ON r.user_id IS NOT DISTINCT FROM s.user_id AND r.n = s.n + 1)
        SELECT user_id, created_at, id, allowed FROM s"""


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir).filter("created_at IS NOT NULL").select("user_id", "created_at", "id", (F.col("type") != 5).alias("ok"))


_FREE = "(len(q) < 3 OR r.created_at - q[1] >= 3600)"


@query(_in_turn("true AS allowed, [created_at] AS q", f"{_FREE}, CASE WHEN {_FREE} THEN list_append(CASE WHEN len(q) >= 3 THEN q[2:] ELSE q END, r.created_at) ELSE q END", "1 AS x"))
def rate_limit_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limits.sliding(_requests(spark, sf_dir), "user_id", "created_at", "id", 3, 3600)


_FULL = "least(5.0::DOUBLE, tokens + (r.created_at - seen) * 0.01::DOUBLE)"


@query(_in_turn("true AS allowed, 4.0::DOUBLE AS tokens, created_at AS seen", f"{_FULL} >= 1.0, CASE WHEN {_FULL} >= 1.0 THEN {_FULL} - 1.0 ELSE {_FULL} END, r.created_at", "1 AS x"))
def rate_limit_token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limits.token_bucket(_requests(spark, sf_dir), "user_id", "created_at", "id", 0.01, 5)


_ROOM = "(len(q) < 2 OR r.created_at - q[1] >= 3600)"
_HELD = "least(5 * 3600, tokens + (r.created_at - seen) * 5)"


@query(_in_turn("true AS allowed, CASE WHEN coalesce(type <> 5, false) THEN [created_at] ELSE []::BIGINT[] END AS q, (4 * 3600)::BIGINT AS tokens, created_at AS seen", f"""{_ROOM} AND {_HELD} >= 3600, CASE WHEN {_ROOM} AND {_HELD} >= 3600 AND coalesce(r.type <> 5, false) THEN list_append(CASE WHEN len(q) >= 2 THEN q[2:] ELSE q END, r.created_at) ELSE q END,
    CASE WHEN NOT {_ROOM} THEN tokens WHEN {_HELD} >= 3600 THEN {_HELD} - 3600 ELSE {_HELD} END, CASE WHEN {_ROOM} THEN r.created_at ELSE seen END""", "1 AS x"))
def rate_limit_dual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bucket of five requests an hour, and two in an hour that didn't end in an error."""
    return limits.dual(_requests(spark, sf_dir), "user_id", "created_at", "id", "ok", 5, 2, 3600)


@query("SELECT record_id, task_id, status FROM task_record WHERE status IS NOT NULL AND upper(status) NOT IN ('SUCCESS', 'FAILURE') AND received_at < (SELECT max(received_at) FROM task_record) - INTERVAL 7 DAY ORDER BY record_id LIMIT 100")
def task_unfinished(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first tasks that neither succeeded nor failed and are a week old."""
    tasks = table(spark, sf_dir, "task_record")
    cut = tasks.agg(F.max("received_at")).scalar() - F.expr("INTERVAL 7 DAY")
    return tasks.filter(~F.upper("status").isin("SUCCESS", "FAILURE") & (F.col("received_at") < cut)).orderBy("record_id").limit(100).select("record_id", "task_id", "status")


@query("SELECT task_id, arg_max(record_id, (received_at, record_id)) AS record_id, count(*) AS deliveries FROM task_record WHERE task_id IS NOT NULL GROUP BY task_id")
def task_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last delivery of each task."""
    tasks = table(spark, sf_dir, "task_record").filter("task_id IS NOT NULL")
    return tasks.groupBy("task_id").agg(F.max_by("record_id", F.struct("received_at", "record_id")).alias("record_id"), F.count("*").alias("deliveries"))


@query("SELECT platform, upper(trim(coalesce(status, 'unknown'))) AS status, count(*) AS n, floor(epoch(min(received_at)))::BIGINT AS first_at, floor(epoch(max(received_at)))::BIGINT AS last_at FROM task_record GROUP BY 1, 2")
def task_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.upper(F.trim(F.coalesce("status", F.lit("unknown"))))
    return table(spark, sf_dir, "task_record").groupBy("platform", status.alias("status")).agg(F.count("*").alias("n"), F.unix_timestamp(F.min("received_at")).alias("first_at"), F.unix_timestamp(F.max("received_at")).alias("last_at"))


@query("SELECT model_name, created_at - created_at % 3600 AS hour, count(*) AS count, sum(quota)::BIGINT AS quota FROM usage_log WHERE type = 2 GROUP BY ALL")
def stream_usage_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hourly rollup as a stream, run until its source is used up."""
    return rollups.hourly_usage(spark, f"{sf_dir}/usage_log.parquet")


@query(PERF_ROLLUP)
def stream_perf_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.perf_buckets(spark, f"{sf_dir}/perf_sample.parquet")


@query(f"SELECT * FROM ({PERF_ROLLUP}) WHERE bucket + 3600 <= (SELECT max(created_at) FROM perf_sample) - 600")
def stream_perf_completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets that are complete: over for ten minutes."""
    return rollups.perf_completed(spark, f"{sf_dir}/perf_sample.parquet", "10 minutes")


@query("SELECT user_id, count(*) AS requests, coalesce(sum(quota), 0)::BIGINT AS used_quota FROM usage_log WHERE type = 2 GROUP BY user_id")
def stream_counter_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' counters, to which every micro-batch adds what it holds."""
    return rollups.user_deltas(spark, f"{sf_dir}/usage_log.parquet")


@query(CACHE_WINDOWS)
def stream_cache_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of cached tokens as a stream keeps them; an hour without use ends a window."""
    used = cached_use(rollups.watch(spark, f"{sf_dir}/usage_log.parquet")).withWatermark("event_time", rollups.LATEST)
    return rollups.drain(U.cache_windows(used, ["model_name", "group_name"], 3600), ["model_name", "group_name", "first_at"], mode="complete")


@query("SELECT k AS request, 1::BIGINT AS rows FROM (SELECT coalesce(request_id, '#' || id) AS k FROM usage_log) GROUP BY k")
def stream_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each request once, as a stream drops what is delivered again; rows without a request id stand for themselves."""
    request = F.coalesce("request_id", F.concat(F.lit("#"), F.col("id").cast("string"))).alias("request")
    first = rollups.once(rollups.watch(spark, f"{sf_dir}/usage_log.parquet").select(request, "event_time"), "request", rollups.LATEST)
    return rollups.drain(first.select("request", F.lit(1).cast("long").alias("rows")), ["request"], mode="append")


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.shred(table(spark, sf_dir, "task_record"), "record_id", "payload")


# Payloads in SQL: members by compared name, strings that hold JSON opened up to three times.
def _opened(x: str) -> str:
    return f"CASE WHEN json_type({x}) = 'VARCHAR' AND regexp_matches({x} ->> '$', '^\\s*[{{\\[\"n]') AND json_valid({x} ->> '$') AND json_type(({x} ->> '$')::JSON) IN ('OBJECT', 'ARRAY', 'VARCHAR', 'NULL') THEN ({x} ->> '$')::JSON ELSE {x} END"


def _thrice(name: str, source: str, keys: str) -> str:
    return ", ".join(f"{name}{n} AS (SELECT {keys}, {_opened('j')} AS j FROM {source if n == 1 else f'{name}{n - 1}'})" for n in (1, 2, 3))


def _member(source: str, keys: str, name: str) -> str:
    return f"SELECT {keys}, arg_min(e.value, e.rowid) AS j FROM {source} s, json_each(s.j) e WHERE json_type(s.j) = 'OBJECT' AND lower(replace(e.key, '_', '')) = '{name}' AND json_type(e.value) <> 'NULL' GROUP BY {keys}"


def _level(name: str, source: str, keys: str, held: str) -> str:
    items = f"SELECT {keys}, (e.key::INTEGER + 1)::INTEGER AS {name}_no, e.value AS j FROM {name}l3 s, json_each(CASE json_type(s.j) WHEN 'ARRAY' THEN s.j WHEN 'OBJECT' THEN json_array(s.j) ELSE '[]'::JSON END) e"
    return ", ".join([f"{name}m AS ({_member(source, keys, held)})", _thrice(f"{name}l", f"{name}m", keys), f"{name}i AS ({items})", _thrice(f"{name}o", f"{name}i", f"{keys}, {name}_no"), f"{name}s AS (SELECT * FROM {name}o3 WHERE json_type(j) = 'OBJECT')"])


_TASKS = f"""WITH p AS (SELECT record_id, payload::JSON AS j FROM task_record WHERE json_valid(payload)), {_thrice("t", "p", "record_id")}, top AS (SELECT * FROM t3 WHERE json_type(j) = 'OBJECT'),
    own AS ({_member("top", "record_id", "clips")}), d AS ({_member("top", "record_id", "data")}), {_thrice("d", "d", "record_id")},
    task AS (SELECT top.record_id, CASE WHEN own.j IS NULL AND json_type(d3.j) = 'OBJECT' THEN d3.j ELSE top.j END AS j FROM top LEFT JOIN own USING (record_id) LEFT JOIN d3 USING (record_id)),
    {_level("clip", "task", "record_id", "clips")}, {_level("rendition", "clips", "record_id, clip_no", "renditions")}, {_level("file", "renditions", "record_id, clip_no, rendition_no", "files")}"""


@query(f"{_TASKS} SELECT record_id, clip_no, rendition_no, file_no FROM files")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.files_only(table(spark, sf_dir, "task_record"), "record_id", "payload")


def p2_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.tables(_tasks(spark, sf_dir), "record_id")["records"]


def p2_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.tables(_tasks(spark, sf_dir), "record_id")["clips"]


def p2_renditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.tables(_tasks(spark, sf_dir), "record_id")["renditions"]


def p2_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.tables(_tasks(spark, sf_dir), "record_id")["files"]


@query(f"{_TASKS} SELECT record_id FROM task_record WHERE record_id NOT IN (SELECT record_id FROM top)")
def p2_unreadable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.tables(_tasks(spark, sf_dir), "record_id")["unreadable"]


def p2_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many objects there are of each level and variant."""
    return nested.variants(_tasks(spark, sf_dir))


def p2_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The own members of all variants, typed, under the keys of their objects."""
    return nested.values(_tasks(spark, sf_dir), "record_id")


def p2_subtype_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows, own columns and values in these the typed table of each variant has, on every level, counted from these tables.

    The values are those that aren't null, so that every column is read as its type.
    """
    objects = nested.written(table(spark, sf_dir, "task_record"), "record_id", "payload")
    each = []
    for at, level in enumerate(["record", *(x.name for x in nested.LEVELS)]):
        for variant, t in nested.subtypes(objects, "record_id", level).items():
            own = [F.col(f"`{c.replace('`', '``')}`").isNotNull().cast("long") for c in t.columns[1 + at :]]
            each.append(t.select(F.lit(level).alias("level"), F.lit(variant).alias("variant"), F.lit(len(own)).alias("own_columns"), reduce(Column.__add__, own, F.lit(0)).alias("n")))
    none = spark.createDataFrame([], "level string, variant string, own_columns int, n long")
    return reduce(DataFrame.unionByName, each, none).groupBy("level", "variant", "own_columns").agg(F.count("*").alias("objects"), F.sum("n").alias("own_values"))


QUERIES |= {f.__name__: f for f in (p2_records, p2_clips, p2_renditions, p2_files, p2_variants, p2_values, p2_subtype_rows)}
