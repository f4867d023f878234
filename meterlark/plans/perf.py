"""Queries on performance samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from meterlark import sources
from meterlark.operators import perf as P, usage as U
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


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "perf_sample")


ROLLUP = """SELECT model AS model_name, CASE WHEN trim(coalesce(group_name, '')) = '' THEN 'default' ELSE group_name END AS group_name, created_at - created_at % 3600 AS bucket, count(*) AS request_count, count(*) FILTER (success) AS success_count,
    sum(greatest(coalesce(latency_ms, 0), 0))::BIGINT AS total_latency_ms, sum(CASE WHEN coalesce(has_ttft, false) AND ttft_ms > 0 THEN ttft_ms ELSE 0 END)::BIGINT AS ttft_sum_ms, count(*) FILTER (coalesce(has_ttft, false) AND ttft_ms > 0) AS ttft_count,
    sum(CASE WHEN output_tokens > 0 AND generation_ms > 0 THEN output_tokens ELSE 0 END)::BIGINT AS output_tokens, sum(CASE WHEN output_tokens > 0 AND generation_ms > 0 THEN generation_ms ELSE 0 END)::BIGINT AS generation_ms
    FROM perf_sample WHERE trim(model) <> '' GROUP BY 1, 2, 3"""
SUMS = ", ".join(f"sum({c})::BIGINT AS {c}" for c in P.COUNTERS)
MEASURES = """CASE WHEN request_count > 0 THEN total_latency_ms // request_count ELSE 0 END AS avg_latency_ms, CASE WHEN ttft_count > 0 THEN ttft_sum_ms // ttft_count ELSE 0 END AS avg_ttft_ms,
    CASE WHEN request_count > 0 THEN round(success_count * 100.0::DOUBLE / request_count * 100.0) / 100.0 ELSE 0.0::DOUBLE END AS success_rate, CASE WHEN generation_ms > 0 AND output_tokens > 0 THEN round(output_tokens * 1000.0::DOUBLE / generation_ms * 100.0) / 100.0 ELSE 0.0::DOUBLE END AS tps"""
RATE = "success_count * 100.0::DOUBLE / request_count"
COLOUR = f"CASE WHEN request_count <= 0 THEN 'empty' WHEN {RATE} >= 95 THEN 'green' WHEN {RATE} >= 80 THEN 'yellow' ELSE 'red' END"


@query(ROLLUP)
def perf_sample_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.rollup(samples(spark, sf_dir))


@query(ROLLUP)
def perf_upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored buckets, to which what came later is added."""
    df = samples(spark, sf_dir)
    cut = U.latest(df) - 5 * 86_400
    return sources.add_counters(P.rollup(df.filter(F.col("created_at") < cut)), P.rollup(df.filter(F.col("created_at") >= cut)), P.KEYS, P.COUNTERS)


@query(f"SELECT * FROM ({ROLLUP}) WHERE bucket >= (SELECT max(created_at) FROM perf_sample) - 7 * 86400")
def perf_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = samples(spark, sf_dir)
    return sources.keep_since(P.rollup(df), "bucket", U.latest(df) - 7 * 86_400, 7)


@query(f"SELECT model_name, {SUMS} FROM ({ROLLUP}) WHERE request_count > 0 GROUP BY model_name")
def perf_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.sums(P.rollup(samples(spark, sf_dir)), "model_name")


def _recent(hours: int) -> str:
    return f"SELECT * FROM ({ROLLUP}) WHERE bucket >= (SELECT max(created_at) FROM perf_sample) - {hours} * 3600"


@query(f"SELECT model_name, request_count, {MEASURES} FROM (SELECT model_name, {SUMS} FROM ({_recent(720)}) GROUP BY model_name)")
def perf_summary_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every model over the longest span, which is what asking for a thousand hours gives."""
    df = samples(spark, sf_dir)
    return P.summary(P.recent(P.rollup(df), U.latest(df), 1000))


@query(f"SELECT group_name, bucket, request_count, {MEASURES} FROM (SELECT group_name, bucket, {SUMS} FROM ({_recent(168)}) WHERE model_name = 'lumora-mini' GROUP BY group_name, bucket)")
def perf_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The series of one model over a week, a row for each of its points."""
    df = samples(spark, sf_dir)
    points = P.series(P.recent(P.rollup(df), U.latest(df), 168), "lumora-mini").select("group_name", F.explode("series").alias("p"))
    return points.select("group_name", "p.bucket", "p.request_count", "p.avg_latency_ms", "p.avg_ttft_ms", "p.success_rate", "p.tps")


@query(f"SELECT group_name, request_count, n_points, {MEASURES} FROM (SELECT group_name, count(DISTINCT bucket) AS n_points, {SUMS} FROM ({_recent(24)}) WHERE model_name = 'lumora-mini' GROUP BY group_name)")
def perf_query_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The totals of one model over the default span, a day."""
    df = samples(spark, sf_dir)
    return P.series(P.recent(P.rollup(df), U.latest(df)), "lumora-mini").withColumn("n_points", F.size("series").cast("long")).drop("series")


@query(f"""WITH r AS ({_recent(720)}), now AS (SELECT max(created_at) AS t FROM perf_sample), m AS (SELECT model_name, bucket, {SUMS} FROM r GROUP BY 1, 2), axis AS (SELECT n.model_name, b.bucket FROM (SELECT DISTINCT model_name FROM m) n, (SELECT unnest(range((SELECT (t - 720 * 3600) - (t - 720 * 3600) % 3600 FROM now), (SELECT t FROM now) + 1, 3600)) AS bucket) b),
    d AS (SELECT axis.model_name, axis.bucket, {", ".join(f"coalesce({c}, 0)::BIGINT AS {c}" for c in P.COUNTERS)} FROM axis LEFT JOIN m ON axis.model_name = m.model_name AND axis.bucket = m.bucket)
    SELECT model_name, bucket, request_count, {MEASURES}, {COLOUR} AS colour FROM d""")
def status_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = samples(spark, sf_dir)
    return P.board(P.rollup(df), U.latest(df), 720)


@query(f"SELECT model_name, request_count, {COLOUR} AS colour, CASE {COLOUR} WHEN 'red' THEN 0 WHEN 'yellow' THEN 1 WHEN 'green' THEN 2 ELSE 3 END::BIGINT AS place FROM (SELECT model_name, {SUMS} FROM ({ROLLUP}) GROUP BY model_name)")
def status_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = P.sums(P.rollup(samples(spark, sf_dir)), "model_name")
    return P.board_order(merged.select("model_name", "request_count", P.colour(P.success_rate(), F.col("request_count")).alias("colour")))


@query("""SELECT count(*) AS n, sum(generation)::BIGINT AS generation FROM (SELECT CASE WHEN coalesce(has_ttft, false) AND latency_ms - ttft_ms > 0 THEN latency_ms - ttft_ms ELSE greatest(coalesce(latency_ms, 0), 0) END AS generation FROM perf_sample)""")
def perf_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time of generation: behind the first token for streams, else all of it."""
    behind = F.col("latency_ms") - F.col("ttft_ms")
    took = F.when(F.coalesce("has_ttft", F.lit(False)) & (behind > 0), behind).otherwise(F.greatest(F.coalesce("latency_ms", F.lit(0)), F.lit(0)))
    return samples(spark, sf_dir).agg(F.count("*").alias("n"), F.sum(took).alias("generation"))
