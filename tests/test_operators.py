from collections import defaultdict

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from meterlark import sources
from meterlark.operators import catalog, charts, limits, nested, perf, rankings, usage
from meterlark.plans import QUERIES
from meterlark.session import durable, table
from meterlark.streaming import rollups


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# rankings and charts: properties


def test_rank_properties(spark, data):
    r = QUERIES["rank_vendors"](spark, data).toPandas()
    assert abs(r["share"].sum() - 1) < 0.01 and list(r.sort_values("rank")["rank"]) == list(range(1, len(r) + 1))
    total = QUERIES["rank_totals"](spark, data).agg(F.sum("tokens")).first()[0]
    assert QUERIES["model_history"](spark, data).agg(F.sum("tokens")).first()[0] == total
    per = QUERIES["vendor_share_history"](spark, data).groupBy("bucket").agg(F.sum("share").alias("s")).toPandas()
    assert ((per["s"] - 1).abs() < 0.01).all()


def test_periods():
    assert rankings.period("") == (7 * 86400, 86400)
    with pytest.raises(ValueError):
        rankings.period("decade")
    with pytest.raises(ValueError):
        usage.span(0, 2_592_001)
    assert usage.span(10, 5) == (10, 10)
    assert perf.hours(0) == 24 and perf.hours(9999) == 720


def test_status_colour(spark):
    cases = [(100.0, 0, "empty"), (99.0, 10, "green"), (95.0, 1, "green"), (90.0, 10, "yellow"), (80.0, 1, "yellow"), (50.0, 10, "red")]
    df = spark.createDataFrame(cases, "rate double, n long, want string")
    assert df.filter(perf.colour(F.col("rate"), F.col("n")) != F.col("want")).count() == 0


def test_board_is_dense(spark, data):
    b = QUERIES["status_board"](spark, data)
    counts = {r["n"] for r in b.groupBy("model_name").agg(F.count("*").alias("n")).collect()}
    assert len(counts) == 1


def test_rollup_of_rollup(spark, data):
    r = usage.rollup(table(spark, data, "usage_log"))
    twice = sources.add_counters(usage.regroup(r, "model_name", "hour").filter("hour % 2 = 0"), usage.regroup(r, "model_name", "hour"), ["model_name", "hour"], usage.COUNTERS)
    assert twice.agg(F.sum("count")).first()[0] >= r.agg(F.sum("count")).first()[0]
    assert rows(usage.regroup(usage.rollup(table(spark, data, "usage_log"), 60).withColumn("hour", F.col("hour") - F.col("hour") % 3600), "user_id", "username", "model_name", "hour")) == rows(r.select("user_id", "username", "model_name", "hour", *usage.COUNTERS))


def test_empty_tables(spark, data):
    none = table(spark, data, "usage_log").limit(0)
    assert usage.rollup(none).count() == 0
    assert usage.stat(none, F.lit(0)).first().asDict() == {"quota": 0, "rpm": 0, "tpm": 0}
    assert rankings.models(rankings.period_sums(none, F.lit(0), "week")).count() == 0
    assert rankings.models(rankings.period_sums(none, F.lit(0), "all")).count() == 0
    assert perf.board(perf.rollup(table(spark, data, "perf_sample").limit(0)), F.lit(0)).count() == 0
    assert charts.padded(spark.createDataFrame([], "bucket long, value long"), 7, 3600).count() == 0


def test_padding(spark):
    p = spark.createDataFrame([(3600, 4), (7200, 5)], "bucket long, value long")
    assert rows(charts.padded(p, 4, 3600)) == [(-3600, 0), (0, 0), (3600, 4), (7200, 5)]


def test_name_rules(spark):
    meta = spark.createDataFrame([(1, "a-1", 0, 9, 1), (2, "a", 1, 8, 1), (3, "-1", 3, 7, 1), (4, "x", 2, 6, 1), (5, "x", 2, 5, 1)], "id long, model_name string, name_rule long, vendor_id long, status long")
    names = spark.createDataFrame([("a-1",), ("a-2",), ("b-1",), ("bxb",), ("none",), ("",), (None,)], "model_name string")
    assert {r["model_name"]: r["meta_id"] for r in catalog.match_names(names, meta).collect()} == {"a-1": 1, "a-2": 2, "b-1": 3, "bxb": 4}


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, "s"), (2, "t"), (3, "u")], "id long, password string")
    sources.overwrite(df, str(tmp_path / "t"))
    back = sources.read(spark, str(tmp_path / "t"))
    assert back.columns == ["id"] and sources.lookup(back, "id", 2).count() == 1
    assert [r["id"] for r in sources.key_range(back, "id", 1, 1).collect()] == [2]
    assert sources.page(back, [F.col("id")], 2, 2).collect()[0]["id"] == 3
    assert sources.keep_since(back, "id", 3, 0).count() == 3 and sources.keep_since(back, "id", 3, 1).count() == 1
    assert durable(df).count() == 3


# limiters against a walk through each key's requests


def slid(times, most, seconds):
    queue, out = [], []
    for t in times:
        if len(queue) < most:
            queue.append(t)
            out.append(True)
        elif t - queue[0] >= seconds:
            queue = queue[1:] + [t]
            out.append(True)
        else:
            out.append(False)
    return out


def bucketed(times, rate, capacity):
    tokens, last, out = capacity, None, []
    for t in times:
        if last is not None:
            tokens = min(capacity, tokens + (t - last) * rate)
        last = t
        out.append(tokens >= 1)
        tokens -= tokens >= 1
    return out


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 60)), max_size=60))
def test_limiters(spark, requests):
    df = spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(requests)], "key long, at long, id long")
    by = defaultdict(list)
    for i, (k, t) in enumerate(requests):
        by[k].append((t, i))
    for make, walk in ((lambda: limits.sliding(df, "key", "at", "id", 3, 10), lambda x: slid(x, 3, 10)), (lambda: limits.token_bucket(df, "key", "at", "id", 0.5, 4), lambda x: bucketed(x, 0.5, 4))):
        got = {r["id"]: r["allowed"] for r in make().collect()}
        want = {i: a for seq in by.values() for (_, i), a in zip(sorted(seq), walk([t for t, _ in sorted(seq)]))}
        assert got == want


def both(rows, total, success, seconds):
    done, out, tokens, last = [], [], total * seconds, None
    for t, ok in rows:
        if len(done) >= success and t - done[-success] < seconds:
            out.append(False)
            continue
        tokens, last = min(total * seconds, tokens + (0 if last is None else t - last) * total), t
        out.append(tokens >= seconds)
        if tokens >= seconds:
            tokens -= seconds
            done += [t] if ok else []
    return out


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 80), st.booleans()), max_size=60))
def test_dual_limiter(spark, requests):
    df = spark.createDataFrame([("k", t, i, ok) for i, (t, ok) in enumerate(requests)], "key string, at long, id long, ok boolean")
    got = {r["id"]: r["allowed"] for r in limits.dual(df, "key", "at", "id", "ok", 4, 2, 10).collect()}
    seq = sorted((t, i, ok) for i, (t, ok) in enumerate(requests))
    assert got == dict(zip([i for _, i, _ in seq], both([(t, ok) for t, _, ok in seq], 4, 2, 10)))


def test_limiters_and_nulls(spark):
    big = 9007199254740993
    df = spark.createDataFrame([(None, 5, i) for i in range(4)] + [(big, 5, 10), (big - 1, 5, 11), (big, None, 12)], "key long, at long, id long")
    got = {r["id"]: (r["key"], r["allowed"]) for r in limits.sliding(df, "key", "at", "id", 1, 3600).collect()}
    assert got == {0: (None, True), 1: (None, False), 2: (None, False), 3: (None, False), 10: (big, True), 11: (big - 1, True), 12: (big, None)}


def test_intermediate_folder_must_be_shared(spark, monkeypatch):
    from types import SimpleNamespace as N

    from meterlark import session

    away = N(conf=N(get=lambda *_: None), sparkContext=N(getCheckpointDir=lambda: None, master="spark://there:7077"))
    with pytest.raises(RuntimeError):
        session._shared_dir(away)


def test_windows_of_use(spark):
    from datetime import datetime, timezone

    at = lambda s: datetime.fromtimestamp(s, timezone.utc)
    df = spark.createDataFrame([("m", at(0), 5, 1, 1, "plain"), ("m", at(10), 0, 2, 2, "stream"), ("m", at(20), None, 4, 4, None), ("m", at(31), 1, 8, 8, "plain")], "k string, event_time timestamp, cached long, prompt_tokens long, completion_tokens long, mode string")
    assert rows(usage.cache_windows(df, ["k"], 10)) == [("m", 0, 20, 3, 1, 5, 7, 7, "mixed"), ("m", 31, 31, 1, 1, 1, 8, 8, "plain")]


def test_summary_of_a_day(spark):
    df = spark.createDataFrame([(0, 1, 1, 1), (172_800, 2, 2, 2), (176_400, 4, 4, 4)], "hour long, count long, quota long, token_used long")
    assert rows(usage.day_summary(df, F.lit(0), F.lit(10**9))) == [(3, 3, 3)] and rows(usage.day_summary(df, F.lit(172_800), F.lit(0))) == [(2, 2, 2)]


def test_append(spark, tmp_path):
    for i in range(2):
        sources.append(spark.createDataFrame([(i, "x")], "id long, part string"), str(tmp_path / "a"), ["part"])
    assert sources.read(spark, str(tmp_path / "a")).count() == 2


# streams


def test_stream_is_the_batch(spark, data):
    mine = rollups.hourly_usage(spark, f"{data}/usage_log.parquet")
    batch = usage.regroup(usage.rollup(table(spark, data, "usage_log")), "model_name", "hour").select("model_name", "hour", "count", "quota")
    assert rows(mine.select("model_name", "hour", "count", "quota")) == rows(batch)


def test_stream_in_batches(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([("m", 3600 + i, 2, 10 * (i + 1))], "model_name string, created_at long, type int, quota long").coalesce(1).write.mode("append").parquet(str(tmp_path / "s"))
    r = rollups.watch(spark, str(tmp_path / "s"), per_batch=1)
    sums = rollups.tumbling(r, ["model_name"], [F.count("*").alias("count"), F.sum("quota").alias("quota")])
    assert rows(rollups.drain(sums, ["model_name"])) == [("m", 3, 60)]


# nested records


def brute(payload):
    """Files of a payload by a plain walk."""
    import json

    def o(v):
        while isinstance(v, str):
            try:
                w = json.loads(v)
            except ValueError:
                return v
            v = w
        return v

    def get(d, name):
        for k, v in d.items():
            if k.replace("_", "").lower() == name and v is not None:
                return o(v)
        return None

    def items(v):
        return [v] if isinstance(v, dict) else v if isinstance(v, list) else []

    try:
        top = o(json.loads(payload))
    except (TypeError, ValueError):
        return []
    if not isinstance(top, dict):
        return []
    if get(top, "clips") is None and isinstance(get(top, "data"), dict):
        top = get(top, "data")
    return [
        (i, j, k)
        for i, c in enumerate(items(get(top, "clips")), 1) if isinstance(o(c), dict)
        for j, r in enumerate(items(get(o(c), "renditions")), 1) if isinstance(o(r), dict)
        for k, f in enumerate(items(get(o(r), "files")), 1) if isinstance(o(f), dict)
    ]


CASES = [
    None, "", " ", "null", "[]", "7", "{", '{"clips":null}', '{"clips":[]}', '"{\\"clips\\": []}"',
    '{"clips":[{"renditions":[{"files":[{"u":1},null,{"u":2}]}]}]}',
    '{"data":{"Clips":{"Rendi_tions":{"FILES":{"u":1}}}}}',
    '{"data":"{\\"clips\\":[null,{\\"renditions\\":\\"[{\\\\\\"files\\\\\\":[{}]}]\\"}]}"}',
    '{"clips":[5,{"renditions":["x",{"files":[[],{},"{}"]}]}],"data":{"clips":[{"renditions":[{"files":[{}]}]}]}}',
    '{"clips":[{"renditions":[{"files":[NaN,{}]}]}]}',
    '{"attempts":[{"error":{"files":[{"log":"a"}]}}],"clips":[{"files":[{}],"renditions":[]}]}',
    "[" * 5000, '{"data":{"data":{"clips":[{"renditions":[{"files":[{}]}]}]}}}',
]


def test_nested_cases(spark):
    df = spark.createDataFrame([(i, p, "x") for i, p in enumerate(CASES)] + [(10, CASES[10], "again")], "record_id long, payload string, level string")
    got = sorted(map(tuple, nested.files_only(df, "record_id", "payload").collect()))
    want = [(i, *f) for i, p in enumerate(CASES) if "NaN" not in (p or "") for f in brute(p)] + [(10, *f) for f in brute(CASES[10])]
    assert got == sorted(want)
    unreadable = {r[0] for r in nested.tables(nested.shred(df, "record_id", "payload"), "record_id")["unreadable"].collect()}
    assert unreadable == {0, 1, 2, 3, 4, 5, 6, 14, 16}


def test_nested_tables(spark, data):
    t = table(spark, data, "task_record")
    found = sorted(map(tuple, nested.files_only(t, "record_id", "payload").collect()))
    assert found == sorted((r["record_id"], *f) for r in t.collect() for f in brute(r["payload"])) and found
    objects = nested.written(t, "record_id", "payload")
    flat = nested.tables(objects, "record_id")
    assert flat["files"].join(flat["renditions"], ["record_id", "clip_no", "rendition_no"], "left_anti").count() == 0
    assert flat["renditions"].join(flat["clips"], ["record_id", "clip_no"], "left_anti").count() == 0
    assert flat["clips"].join(flat["records"], "record_id", "left_anti").count() == 0
    assert flat["records"].count() + flat["unreadable"].count() == t.count()
    for level in ("record", "clip", "rendition", "file"):
        each = nested.subtypes(objects, "record_id", level)
        assert sum(x.count() for x in each.values()) == flat[f"{level}s"].count()
    assert nested.shred(t.limit(0), "record_id", "payload").count() == 0


def test_nested_states():
    s = nested.state
    assert s({"a": {"b": [1]}}) != s({"z": 1}) and s({"a": {"b": [1]}}) == s({"A": '{"B_": [2, 7]}'}) != s({"a": {"b": ["x"]}})
    assert [s(x) for x in (None, True, 5, 5.5, "5", "", "null", "[1]", [], [1, "a", None], [[1]])] == ["null", "bool", "int", "number", "text", "text", "null", "list<int>", "list<>", "list<int|null|text>", "list<list<int>>"]
    assert nested.own_members('a:list<int|text>,"b,:":object#12,c:text', ("c",), None) == [("a", "list<int|text>"), ("b,:", "object#12")]


def test_nested_subtypes(spark):
    payloads = ['{"task_id": "t", "n": 5, "clips": [{"title": "x", "w": 1.5, "deep": {"a": [1]}, "record_id": true}, {"title": "y", "w": "1.5"}]}', '{"task_id": 7, "n": "5", "clips": {"W": 2.5, "deep": {"a": [2]}, "recordid": false, "title": "z"}}']
    df = spark.createDataFrame(list(enumerate(payloads)), "record_id long, payload string")
    objects = nested.written(df, "record_id", "payload")
    clips = nested.subtypes(objects, "record_id", "clip")
    wide = clips["deep:" + nested.state({"a": [1]}) + ",recordid:bool,title:text,w:number"]
    assert wide.dtypes == [("record_id", "bigint"), ("clip_no", "int"), ("deep", "string"), ("recordid", "boolean"), ("w", "double")]
    assert sorted(map(tuple, wide.collect())) == [(0, 1, '{"a":[1]}', True, 1.5), (1, 1, '{"a":[2]}', False, 2.5)]
    assert {k: t.dtypes[1] for k, t in nested.subtypes(objects, "record_id", "record").items()} == {"clips:list<clip>,n:int,taskid:text": ("n", "bigint"), "clips:list<clip>,n:text,taskid:int": ("n", "string")}
    got = {(r["record_id"], r["clip_no"], r["member"]): (r["kind"], r["text"], r["whole"], r["fraction"], r["flag"]) for r in nested.values(objects, "record_id").collect()}
    assert got[0, None, "n"] == ("int", "5", 5, None, None) and got[1, None, "n"] == ("text", "5", None, None, None) and got[0, 1, "w"] == ("number", "1.5", None, 1.5, None) and got[0, 1, "recordid"] == ("bool", "true", None, None, True)


def test_nested_deeply(spark):
    deep = "[" * 30_000 + "]" * 30_000
    objects = '{"a":' * 30_000 + "1" + "}" * 30_000
    folded = '{"clips":[{"renditions":[{"files":[{}]}]}]}'
    for _ in range(11):
        import json

        folded = json.dumps(folded)
    good = '{"x": %s, "clips": [{"y": %s, "renditions": [{"files": [{"meta": %s}]}]}]}'
    rows = [(1, good % (deep, deep, objects)), (2, deep), (3, good % (deep, "1" + deep, "2")), (4, folded), (5, "[" * 30_000)]
    df = spark.createDataFrame(rows, "record_id long, payload string")
    assert sorted(map(tuple, nested.files_only(df, "record_id", "payload").collect())) == [(1, 1, 1, 1), (4, 1, 1, 1)]
    meta = nested.tables(nested.shred(df, "record_id", "payload"), "record_id")["files"].filter("record_id = 1").first()["meta"]
    assert meta.replace(" ", "") == objects


@settings(max_examples=80, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda x: st.lists(x) | st.dictionaries(st.text(), x)))
def test_deep_reader(value):
    import json

    for text in (json.dumps(value), json.dumps(value, indent=1, ensure_ascii=False)):
        assert nested._deep_loads(text) == value
        for broken in (text[:-1], text + "]", text[1:], text.replace(":", ",", 1)):
            try:
                want = json.loads(broken)
            except ValueError:
                with pytest.raises(ValueError):
                    nested._deep_loads(broken)
            else:
                assert nested._deep_loads(broken) == want
