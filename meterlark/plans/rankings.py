"""Queries on rankings and charts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from meterlark.operators import catalog, charts as C, rankings as R, usage as U
from meterlark.plans.usage import NOW, ROLLUP, log
from meterlark.session import durable, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _rolled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rollup without its users: what rankings and charts of models need."""
    return U.rollup(log(spark, sf_dir), keys=("model_name",))


def _month(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = log(spark, sf_dir)
    return R.period_sums(df.filter(F.col("type") == U.CONSUME), U.latest(df), "month")


def _ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.models(_month(spark, sf_dir))


def _vendor_of(spark: SparkSession, sf_dir: str, names: DataFrame) -> DataFrame:
    return catalog.vendor_names(names, table(spark, sf_dir, "model_meta"), table(spark, sf_dir, "vendor"))


def _growth(now: str, before: str) -> str:
    return f"CASE WHEN coalesce({before}, 0) <= 0 THEN CASE WHEN {now} > 0 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END ELSE round(({now} - {before})::DOUBLE / {before} * 100 * 10000.0) / 10000.0 END"


def _share(part: str, whole: str) -> str:
    return f"CASE WHEN {part} > 0 AND {whole} > 0 THEN round({part}::DOUBLE / {whole} * 10000.0) / 10000.0 ELSE 0.0::DOUBLE END"


MATCH = """SELECT model_name, arg_min(meta_id, (o, meta_id)) AS meta_id, arg_min(coalesce(vendor_id, -1), (o, meta_id)) AS vendor_id, arg_min(name_rule, (o, meta_id)) AS name_rule FROM (
    SELECT u.model_name, m.id AS meta_id, m.vendor_id, m.name_rule, CASE m.name_rule WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 3 THEN 2 ELSE 3 END AS o
    FROM (SELECT DISTINCT model_name FROM usage_log WHERE model_name <> '') u JOIN model_meta m ON (m.name_rule = 0 AND u.model_name = m.model_name)
      OR (m.model_name <> '' AND ((m.name_rule = 1 AND starts_with(u.model_name, m.model_name)) OR (m.name_rule = 2 AND contains(u.model_name, m.model_name)) OR (m.name_rule = 3 AND ends_with(u.model_name, m.model_name))))
    ) GROUP BY model_name"""
WINDOWS = f"""r AS ({ROLLUP}), cur AS (SELECT * FROM r WHERE hour >= {NOW} - 2592000 AND hour <= {NOW}), prev AS (SELECT * FROM r WHERE hour >= {NOW} - 5184000 AND hour <= {NOW} - 2592001),
    ct AS (SELECT model_name, sum(token_used)::BIGINT AS tokens FROM cur WHERE model_name <> '' GROUP BY model_name HAVING sum(token_used) > 0),
    pt AS (SELECT model_name, sum(token_used)::BIGINT AS tokens FROM prev WHERE model_name <> '' GROUP BY model_name HAVING sum(token_used) > 0)"""
RANKING = f"""SELECT c.rank, c.model_name, c.tokens, p.rank AS previous_rank, {_share("c.tokens", "(SELECT sum(tokens) FROM ct)")} AS share, {_growth("c.tokens", "p.tokens")} AS growth_pct
    FROM (SELECT *, row_number() OVER (ORDER BY tokens DESC, model_name) AS rank FROM ct) c LEFT JOIN (SELECT *, row_number() OVER (ORDER BY tokens DESC, model_name) AS rank FROM pt) p ON c.model_name = p.model_name"""
VENDOR = f"vo AS (SELECT m.model_name, coalesce(v.name, 'Unknown') AS vendor FROM ({MATCH}) m LEFT JOIN vendor v ON m.vendor_id = v.id)"


@query(f"SELECT model_name, sum(token_used)::BIGINT AS tokens FROM ({ROLLUP}) WHERE model_name <> '' GROUP BY model_name HAVING sum(token_used) > 0")
def rank_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.totals(_rolled(spark, sf_dir))


@query(f"SELECT model_name, (hour // 86400) * 86400 AS bucket, sum(token_used)::BIGINT AS tokens FROM ({ROLLUP}) WHERE model_name <> '' GROUP BY ALL HAVING sum(token_used) > 0")
def rank_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = _rolled(spark, sf_dir).filter("model_name <> ''")
    return named.groupBy("model_name", C.bucket(F.col("hour"), 86_400).alias("bucket")).agg(F.sum("token_used").alias("tokens")).filter("tokens > 0")


@query(f"WITH {WINDOWS} SELECT * FROM ({RANKING}) WHERE rank <= 20")
def rank_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top(_ranking(spark, sf_dir))


def _movers_sql(up: bool) -> str:
    way = "DESC" if up else "ASC"
    return f"WITH {WINDOWS}, k AS ({RANKING}) SELECT model_name, rank, previous_rank, previous_rank - rank AS delta, growth_pct FROM k WHERE previous_rank - rank {'>' if up else '<'} 0 ORDER BY delta {way}, growth_pct {way}, model_name LIMIT 6"


@query(_movers_sql(True))
def rank_movers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.movers(_ranking(spark, sf_dir), True)


@query(_movers_sql(False))
def rank_droppers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.movers(_ranking(spark, sf_dir), False)


@query(f"""WITH {WINDOWS}, {VENDOR}, cv AS (SELECT coalesce(vendor, 'Unknown') AS vendor, sum(tokens)::BIGINT AS tokens, count(*) AS models, arg_min(ct.model_name, (-tokens, ct.model_name)) AS top_model FROM ct LEFT JOIN vo USING (model_name) GROUP BY 1),
    pv AS (SELECT coalesce(vendor, 'Unknown') AS vendor, sum(tokens)::BIGINT AS before FROM pt LEFT JOIN vo USING (model_name) GROUP BY 1)
    SELECT row_number() OVER (ORDER BY tokens DESC, cv.vendor) AS rank, cv.vendor, tokens, models, top_model, {_share("tokens", "(SELECT sum(tokens) FROM cv)")} AS share, {_growth("tokens", "before")} AS growth_pct FROM cv LEFT JOIN pv ON cv.vendor = pv.vendor""")
def rank_vendors(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = durable(_month(spark, sf_dir))  # a row for each model: the log is read once
    return R.vendors(sums, _vendor_of(spark, sf_dir, sums))


@query(f"""WITH r AS ({ROLLUP}), f AS (SELECT model_name FROM r WHERE model_name <> '' GROUP BY 1 HAVING sum(token_used) > 0 ORDER BY sum(token_used) DESC, model_name LIMIT 10)
    SELECT hour - hour % 86400 AS bucket, CASE WHEN f.model_name IS NULL THEN 'Others' ELSE r.model_name END AS model_name, sum(token_used)::BIGINT AS tokens FROM r LEFT JOIN f ON r.model_name = f.model_name WHERE r.model_name <> '' GROUP BY 1, 2 HAVING sum(token_used) > 0""")
def model_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.history(_rolled(spark, sf_dir), R.DAY, "model_name", 10)


@query(f"""WITH {VENDOR}, r AS (SELECT x.*, coalesce(vo.vendor, 'Unknown') AS vendor FROM ({ROLLUP}) x LEFT JOIN vo USING (model_name) WHERE x.model_name <> ''), f AS (SELECT vendor FROM r GROUP BY 1 HAVING sum(token_used) > 0 ORDER BY sum(token_used) DESC, vendor LIMIT 5),
    h AS (SELECT hour - hour % 604800 AS bucket, CASE WHEN f.vendor IS NULL THEN 'Others' ELSE r.vendor END AS vendor, sum(token_used)::BIGINT AS tokens FROM r LEFT JOIN f ON r.vendor = f.vendor GROUP BY 1, 2 HAVING sum(token_used) > 0)
    SELECT *, {_share("tokens", "sum(tokens) OVER (PARTITION BY bucket)")} AS share FROM h""")
def vendor_share_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = durable(_rolled(spark, sf_dir).filter("model_name <> ''"))
    rows = named.join(_vendor_of(spark, sf_dir, named), "model_name", "left").withColumn("vendor", F.coalesce("vendor", F.lit("Unknown")))
    return R.bucket_shares(R.history(rows, 7 * R.DAY, "vendor", 5))


@query(f"""SELECT hour - hour % 86400 AS bucket, strftime(make_timestamp((hour - hour % 86400) * 1000000), '%m-%d') AS label, CASE WHEN coalesce(model_name, '') = '' THEN 'Unknown' ELSE model_name END AS model_name,
    sum(count)::BIGINT AS count, sum(quota)::BIGINT AS quota, sum(token_used)::BIGINT AS token_used FROM ({ROLLUP}) GROUP BY 1, 2, 3""")
def chart_time_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.by_time(_rolled(spark, sf_dir), "day")


@query(f"""SELECT hour - hour % 604800 AS bucket, strftime(make_timestamp((hour - hour % 604800) * 1000000), '%m-%d') || ' - ' || strftime(make_timestamp((hour - hour % 604800 + 518400) * 1000000), '%m-%d') AS label, sum(count)::BIGINT AS count FROM ({ROLLUP}) GROUP BY 1, 2""")
def chart_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.by_time(_rolled(spark, sf_dir), "week").groupBy("bucket", "label").agg(F.sum("count").alias("count"))


@query(f"SELECT CASE WHEN coalesce(model_name, '') = '' THEN 'Unknown' ELSE model_name END AS model_name, sum(count)::BIGINT AS count FROM ({ROLLUP}) GROUP BY 1")
def chart_pie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.by_time(_rolled(spark, sf_dir), "day").groupBy("model_name").agg(F.sum("count").alias("count"))


_DAYS = f"SELECT hour - hour % 86400 AS bucket, CASE WHEN coalesce(model_name, '') = '' THEN 'Unknown' ELSE model_name END AS model_name, sum(quota)::BIGINT AS quota FROM ({ROLLUP}) GROUP BY 1, 2"


@query(f"""WITH s AS ({_DAYS}), axis AS (SELECT m.model_name, b.bucket FROM (SELECT DISTINCT model_name FROM s) m, (SELECT unnest(range((SELECT min(bucket) FROM s), (SELECT max(bucket) FROM s) + 1, 86400)) AS bucket) b)
    SELECT axis.bucket, axis.model_name, coalesce(quota, 0)::BIGINT AS quota, round(coalesce(quota, 0) / 500000.0::DOUBLE * 10000.0) / 10000.0 AS usd, (sum(coalesce(quota, 0)) OVER (PARTITION BY axis.bucket))::BIGINT AS time_sum FROM axis LEFT JOIN s ON axis.bucket = s.bucket AND axis.model_name = s.model_name""")
def chart_stacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense time by model, with the value of the quota at 500,000 a unit."""
    from meterlark.functions.scalars import away

    full = C.dense(C.by_time(_rolled(spark, sf_dir), "day"), "model_name", ["quota"], R.DAY)
    return full.select("bucket", "model_name", "quota", away(F.col("quota") / 500_000.0, 4).alias("usd"), "time_sum")


@query(f"""WITH s AS ({_DAYS}), f AS (SELECT model_name FROM s GROUP BY 1 ORDER BY sum(quota) DESC, model_name LIMIT 15)
    SELECT bucket, CASE WHEN f.model_name IS NULL THEN 'Other' ELSE s.model_name END AS model_name, sum(quota)::BIGINT AS quota FROM s LEFT JOIN f ON s.model_name = f.model_name GROUP BY 1, 2""")
def chart_topn_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.top_and_other(C.by_time(_rolled(spark, sf_dir), "day"), "model_name", "quota", 15)


_COUNTS = _DAYS.replace("sum(quota)::BIGINT AS quota", "sum(count)::BIGINT AS count", 1)


@query(f"""WITH s AS ({_COUNTS}), f AS (SELECT model_name FROM s GROUP BY 1 ORDER BY sum(count) DESC, model_name LIMIT 20), l AS (SELECT bucket, CASE WHEN f.model_name IS NULL THEN 'Other' ELSE s.model_name END AS model_name, count FROM s LEFT JOIN f ON s.model_name = f.model_name),
    axis AS (SELECT m.model_name, b.bucket FROM (SELECT DISTINCT model_name FROM l) m, (SELECT DISTINCT bucket FROM l) b)
    SELECT axis.bucket, axis.model_name, coalesce(sum(count), 0)::BIGINT AS count FROM axis LEFT JOIN l ON axis.bucket = l.bucket AND axis.model_name = l.model_name GROUP BY 1, 2""")
def chart_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests by day of the twenty models of most and of the others, 0 where a day has none."""
    top = C.top_and_other(C.by_time(_rolled(spark, sf_dir), "day"), "model_name", "count", 20)
    return C.steps(top, "model_name", "count")


@query(f"""WITH s AS (SELECT model_name, sum(count) AS n FROM ({_COUNTS}) GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY n DESC, model_name) AS place FROM s)
    SELECT CASE WHEN place <= 20 THEN model_name ELSE 'Other' END AS model_name, sum(n)::BIGINT AS count FROM k GROUP BY 1""")
def chart_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of the twenty models of most and of the others."""
    sums = C.by_time(_rolled(spark, sf_dir), "day").groupBy("model_name").agg(F.sum("count").alias("count"))
    return C.top_and_other(sums.withColumn("bucket", F.lit(0)), "model_name", "count", 20).select("model_name", "count")


@query(f"""WITH s AS (SELECT hour - hour % 86400 AS bucket, CASE WHEN coalesce(username, '') = '' THEN 'Unknown' ELSE username END AS username, sum(quota)::BIGINT AS quota FROM ({ROLLUP}) GROUP BY 1, 2),
    t AS (SELECT username FROM s GROUP BY 1 ORDER BY sum(quota) DESC, username LIMIT 10), o AS (SELECT s.* FROM s JOIN t USING (username)),
    axis AS (SELECT u.username, b.bucket FROM t u, (SELECT unnest(range((SELECT min(bucket) FROM o), (SELECT max(bucket) FROM o) + 1, 86400)) AS bucket) b)
    SELECT axis.bucket, axis.username, coalesce(quota, 0)::BIGINT AS quota, (sum(coalesce(quota, 0)) OVER (PARTITION BY axis.bucket))::BIGINT AS time_sum FROM axis LEFT JOIN o ON axis.bucket = o.bucket AND axis.username = o.username""")
def chart_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten users of most quota by day, dense."""
    sums = C.by_time(U.rollup(log(spark, sf_dir), keys=("username",)), "day", "username")
    top = sums.groupBy("username").agg(F.sum("quota").alias("t")).orderBy(F.desc("t"), "username").limit(10).select("username")
    return C.dense(sums.join(top, "username", "left_semi"), "username", ["quota"], R.DAY)


@query(f"""WITH p AS (SELECT hour AS bucket, sum(count)::BIGINT AS value FROM ({ROLLUP}) WHERE hour >= {NOW} - 7200 GROUP BY 1), axis AS (SELECT unnest(range(least((SELECT min(bucket) FROM p), (SELECT max(bucket) FROM p) - CASE WHEN (SELECT count(*) FROM p) < 7 THEN 6 * 3600 ELSE 0 END), (SELECT max(bucket) FROM p) + 1, 3600)) AS bucket)
    SELECT axis.bucket, coalesce(value, 0) AS value FROM axis LEFT JOIN p ON axis.bucket = p.bucket""")
def chart_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = log(spark, sf_dir)
    points = U.rollup(df, keys=()).filter(F.col("hour") >= U.latest(df) - 7200).groupBy(F.col("hour").alias("bucket")).agg(F.sum("count").alias("value"))
    return C.padded(points, 7, 3600)
