"""Every core query with SQL gives what DuckDB gives on the same tables."""

import datetime
import math
import os
from collections import Counter
from decimal import Decimal

import duckdb
import pytest

from meterlark.plans import QUERIES, SQL


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(v)
    return float(v) if isinstance(v, Decimal) else v


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(data):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{data}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    cols = sorted(df.columns)
    mine = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    q = duck.execute(SQL[name])
    names = [d[0] for d in q.description]
    assert sorted(names) == cols
    place = [names.index(c) for c in cols]
    assert mine == Counter(tuple(plain(r[i]) for i in place) for r in q.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_without_sql(spark, data, name):
    df = QUERIES[name](spark, data)
    assert df.count() >= 0 and df.columns


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.entry(spark).collect()) > 0


def test_filters_reach_the_scan(spark, data):
    plan = QUERIES["log_search_user_total"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(user_id,1007)" in plan and "content" not in plan.split("ReadSchema")[1]


def test_subtype_rows_of_all_levels(spark, tmp_path):
    """Every level's typed tables count, with the values that they hold."""
    payloads = [
        '{"task_id": "t", "n": 5, "x.y": null, "clips": [{"title": "x", "w": 1.5, "renditions": [{"kind": "k", "fps": 30, "files": [{"uri": "u", "a": true, "b": null}, {"uri": "v", "a": false, "b": null}]}]}]}',
        '{"task_id": "u", "n": 99999999999999999999, "x.y": null, "clips": {"title": "y", "w": 2.5}}',
        "broken",
    ]
    spark.createDataFrame(list(enumerate(payloads)), "record_id long, payload string").write.parquet(str(tmp_path / "task_record.parquet"))
    got = sorted(map(tuple, QUERIES["p2_subtype_rows"](spark, str(tmp_path)).select("level", "variant", "own_columns", "objects", "own_values").collect()))
    assert got == [
        ("clip", "renditions:list<rendition>,title:text,w:number", 1, 1, 1),
        ("clip", "title:text,w:number", 1, 1, 1),
        ("file", "a:bool,b:null,uri:text", 2, 2, 2),
        ("record", 'clips:list<clip>,n:bigger,taskid:text,"x.y":null', 2, 1, 1),
        ("record", 'clips:list<clip>,n:int,taskid:text,"x.y":null', 2, 1, 1),
        ("rendition", "files:list<file>,fps:int,kind:text", 1, 1, 1),
    ]
    spark.createDataFrame([], "record_id long, payload string").write.parquet(str(tmp_path / "none" / "task_record.parquet"))
    assert QUERIES["p2_subtype_rows"](spark, str(tmp_path / "none")).count() == 0
