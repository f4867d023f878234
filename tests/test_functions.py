import math
import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from meterlark.functions import formula, json_rules as J, scalars as S


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def test_growth_share_rounding(spark):
    assert one(spark, S.growth(F.lit(5), F.lit(0))) == 100.0
    assert one(spark, S.growth(F.lit(0), F.lit(0))) == 0.0
    assert one(spark, S.growth(F.lit(5), F.lit(None).cast("long"))) == 100.0
    assert one(spark, S.growth(F.lit(3), F.lit(4))) == -25.0
    assert one(spark, S.share(F.lit(1), F.lit(0))) == 0.0
    assert one(spark, S.share(F.lit(1), F.lit(3))) == 0.3333
    assert one(spark, S.away(F.lit(-2.5), 0)) == -3.0 and one(spark, S.away(F.lit(2.5), 0)) == 3.0


def test_bucket(spark):
    assert one(spark, S.bucket(F.lit(7201), 3600)) == 7200
    assert one(spark, S.bucket(F.lit(7201), 0)) == 7200


def test_like(spark):
    assert S.contains(F.lit("x"), "  ") is None
    for text, needle, found in (("a_b", "_", True), ("ab", "_", False), ("50%", "0%", True), ("50", "0%", False), ("wow!", "!", True)):
        assert one(spark, S.contains(F.lit(text), needle)) is found
    with pytest.raises(ValueError):
        S.guarded_like(F.lit("x"), "a%%b")
    with pytest.raises(ValueError):
        S.guarded_like(F.lit("x"), "%a")
    assert one(spark, S.guarded_like(F.lit("abc"), "ab%")) is True
    assert one(spark, S.guarded_like(F.lit("abc"), "ab")) is False


def test_csv(spark):
    assert one(spark, S.csv_items(F.lit(" a, b ,,a"))) == ["a", "b"]
    assert one(spark, S.csv_items(F.lit(None).cast("string"))) == []
    assert S.csv_has(F.lit("a"), "all") is None
    assert one(spark, S.csv_has(F.lit("vip, edu"), "edu")) is True


def test_masks(spark):
    assert one(spark, S.mask_email(F.lit("a.b@c.example"))) == "***@c.example"
    assert one(spark, S.mask_email(F.lit("none"))) == "***masked***"
    assert one(spark, S.mask_email(F.lit(None).cast("string"))) == "***masked***"
    assert one(spark, S.mask_ip(F.lit("at 10.0.0.1!"))) == "at ***.***.***.***!"
    assert one(spark, S.mask_email(F.lit("a@b.example, c@d.example"))) == "***@b.example, c@d.example"
    assert one(spark, S.mask_url(F.lit("https://sub.domain.co.uk/path/to/resource http://host/ https://h.example?a=1&b#f"))) == "https://***.co.uk/***/***/*** http://***/ https://***.example?a=***&b=***"
    assert one(spark, S.mask_url(F.lit("https://a.example/" + "s/" * 400 + "secret"))) == "https://***.example/" + "***/" * 400 + "***"
    assert one(spark, S.mask_url(F.lit("nothing here"))) == "nothing here" and one(spark, S.mask_url(F.lit(""))) == ""
    assert [one(spark, S.mask_domain(F.lit(h))) for h in ("openai.com", "api.openai.com", "sub.domain.co.uk", "co.uk", "at x-y.example!")] == ["***.com", "***.***.com", "***.***.co.uk", "***.co.uk", "at ***.example!"]
    assert one(spark, S.mask_sensitive(F.lit("1.2.3.4 'api_key:abc' on a.b.example"))) == "***.***.***.*** 'api_key:***' on ***.***.example"
    assert one(spark, S.mask_url(F.lit("see https://api.host.example/v1/users?key=s&x=1"))) == "see https://***.example/***/***?key=***&x=***"


def test_status_ranges(spark):
    assert S.status_ranges("500, 400-404,405，410-420") == [(400, 405), (410, 420), (500, 500)]
    assert S.status_ranges("") == []
    for bad in ("99", "600", "404-400", "x"):
        with pytest.raises(ValueError):
            S.status_ranges(bad)
    assert one(spark, S.in_status_ranges(F.lit(None).cast("long"), "400")) is False


def test_calendar(spark):
    day = lambda s: F.lit(s).cast("date")
    assert str(one(spark, S.add_months(day("2025-01-31"), 1))) == "2025-03-03"
    assert str(one(spark, S.add_months(day("2024-01-31"), 1))) == "2024-03-02"
    assert str(one(spark, S.next_reset(F.lit("2025-06-11 10:00:00").cast("timestamp"), "weekly"))) == "2025-06-16 00:00:00"
    assert str(one(spark, S.next_reset(F.lit("2025-12-31 10:00:00").cast("timestamp"), "monthly"))) == "2026-01-01 00:00:00"


def walked(text, family=""):
    """The estimate, character by character."""
    w = S.ESTIMATE_WEIGHTS[family]
    total, run = 0.0, ""
    for c in text:
        o, kind = ord(c), ""
        if c.isspace() and c not in "\x1c\x1d\x1e\x1f":
            total += w["newline"] if c in "\n\t" else w["space"]
        elif 0x4E00 <= o <= 0x9FFF or 0x3040 <= o <= 0x30FF or 0xAC00 <= o <= 0xD7A3:
            total += w["cjk"]
        elif 0x2600 <= o <= 0x27BF or 0x1F300 <= o <= 0x1F9FF:
            total += w["emoji"]
        elif c.isalpha() or c.isnumeric():
            kind = "number" if c.isnumeric() else "word"
            total += w[kind] if kind != run else 0
        elif 0x2200 <= o <= 0x22FF or c in "±×÷":
            total += w["math"]
        else:
            total += w["at"] if c == "@" else w["url"] if c in "/:?&=;#%" else w["symbol"]
        run = kind
    return math.ceil(round(total, 9))


def test_estimate(spark):
    texts = ["", "hello world", "abc123xyz 3.5", "漢字かな交じり text", "a@b.example/x?y=1", "x ≤ y ± 2\n\ttabs", "😀 ok ☂", "über naïve Straße", "…“quotes”—"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for family in ("", "gemini", "claude"):
        got = {r["i"]: r["n"] for r in df.select("i", S.estimate_tokens(F.col("t"), family).alias("n")).collect()}
        assert got == {i: walked(t, family) for i, t in enumerate(texts)}
    assert one(spark, S.estimate_tokens(F.lit(None).cast("string"))) == 0


TIERS = 'p <= 200000 ? tier("first", p * 2 + c) : tier("second", p * 3 + c)'


def run(spark, source, **v):
    value, tier = formula.compile_columns(source, formula.Scope({k: F.lit(x) for k, x in v.items()}, now=F.lit("2025-06-15 23:30:00").cast("timestamp"), body=F.lit('{"a":{"b":"xyz"}}'), headers=F.create_map(F.lit("x-id"), F.lit("7"))))
    r = spark.range(1).select(value.alias("v"), tier.alias("t")).first()
    return r["v"], r["t"]


def test_formula(spark):
    assert run(spark, TIERS, p=200000, c=1) == (400001.0, "first")
    assert run(spark, "v1:" + TIERS, p=300000, c=0) == (900000.0, "second")
    assert run(spark, "1 + 2 * 3 - 4 / 2") == (5.0, None)
    assert run(spark, "-(2 + 3) % 3 + max(1, min(5, 2)) + ceil(1.2) + floor(1.8) + abs(-1)")[0] == -2 + 2 + 2 + 1 + 1
    assert run(spark, "1 / 0")[0] is None
    assert run(spark, 'hour("Asia/Tokyo") * 100 + weekday("Asia/Tokyo")')[0] == 801.0
    assert run(spark, 'has(param("a.b"), "y") ? 1 : 0')[0] == 1.0
    assert run(spark, 'header("X-ID") == "7" && !false ? 2 : 3')[0] == 2.0
    assert formula.names(formula.parse(TIERS)) == {"p", "c"}
    with pytest.raises(NameError):
        run(spark, "p + q", p=1)
    for bad in ("1 +", "f(1)", "max(1)", "1 2", "$"):
        with pytest.raises(SyntaxError):
            formula.parse(bad)


@settings(max_examples=60, deadline=None)
@given(st.recursive(st.integers(0, 99).map(str), lambda e: st.tuples(e, st.sampled_from("+-*"), e).map(lambda t: f"({t[0]} {t[1]} {t[2]})") | st.tuples(e, st.sampled_from(["<", ">=", "=="]), e, e, e).map(lambda t: f"({t[0]} {t[1]} {t[2]} ? {t[3]} : {t[4]})"), max_leaves=12))
def test_formula_parses_like_python(source):
    def value(n):
        if n.kind == "num":
            return n.value
        if n.kind == "if":
            return value(n.parts[1]) if value(n.parts[0]) else value(n.parts[2])
        a, b = map(value, n.parts)
        return {"+": a + b, "-": a - b, "*": a * b, "<": a < b, ">=": a >= b, "==": a == b}[n.value]

    python = source
    while m := re.search(r"\(([^()?:]*(?:\[[^\]]*\])?[^()?:]*) \? ([^()?:]*) : ([^()?:]*)\)", python):
        python = python[: m.start()] + f"[{m[2]} if {m[1]} else {m[3]}][0]".replace("(", "⟨").replace(")", "⟩") + python[m.end() :]
        break
    if "?" not in python:
        assert value(formula.parse(source)) == eval(python.replace("⟨", "(").replace("⟩", ")"))
    else:
        value(formula.parse(source))


DOC = '{"model":"gpt","n":5,"flag":true,"empty":null,"list":[{"name":"a"},{"name":"b"}]}'


def test_conditions(spark):
    check = lambda cs, logic="OR", doc=DOC: one(spark, J.rules(F.lit(doc), cs, logic))
    assert check([]) is True
    assert check([{"path": "model", "mode": "prefix", "value": "gp"}]) is True
    assert check([{"path": "model", "mode": "suffix", "value": "gp"}, {"path": "n", "mode": "gte", "value": 5}]) is True
    assert check([{"path": "model", "mode": "suffix", "value": "gp"}, {"path": "n", "mode": "gte", "value": 5}], "AND") is False
    assert check([{"path": "list.1.name", "mode": "full", "value": "b"}]) is True
    assert check([{"path": "nope", "mode": "full", "value": 1}]) is False
    assert check([{"path": "nope", "mode": "full", "value": 1, "invert": True}]) is False
    assert check([{"path": "nope", "mode": "full", "value": 1, "pass_missing_key": True}]) is True
    assert check([{"path": "n", "mode": "full", "value": 5, "invert": True}]) is False
    assert check([{"path": "flag", "mode": "full", "value": True}]) is True
    assert check([{"path": "model", "mode": "gt", "value": 1}]) is False
    assert check([{"path": "n", "mode": "lt", "value": 1}], doc='{"n":') is False
    with pytest.raises(ValueError):
        J.rules(F.lit(DOC), [{"path": "n", "mode": "like", "value": 1}])


def test_edits(spark):
    e = lambda ops, doc=None: J.edit({"a": " Xy ", "b": {"c": 1}, "l": [{"k": 1, "t": "p"}, {"k": 2}]} if doc is None else doc, ops)
    assert e([{"mode": "set", "path": "b.d.e", "value": 2}])["b"] == {"c": 1, "d": {"e": 2}}
    assert e([{"mode": "set", "path": "b.c", "value": 9, "keep_origin": True}])["b"]["c"] == 1
    assert e([{"mode": "delete", "path": "l.*.k"}])["l"] == [{"t": "p"}, {}]
    assert e([{"mode": "delete", "path": "l.-1"}])["l"] == [{"k": 1, "t": "p"}]
    assert e([{"mode": "move", "from": "b.c", "to": "z"}])["z"] == 1
    assert e([{"mode": "copy", "from": "a", "to": "b.a"}])["b"]["a"] == " Xy "
    assert e([{"mode": "trim_space", "path": "a"}, {"mode": "to_lower", "path": "a"}, {"mode": "ensure_prefix", "path": "a", "value": "x"}, {"mode": "ensure_suffix", "path": "a", "value": "!"}])["a"] == "xy!"
    assert e([{"mode": "append", "path": "l", "value": 3}])["l"][-1] == 3
    assert e([{"mode": "regex_replace", "path": "a", "pattern": "[A-Z]", "to": "_"}])["a"] == " _y "
    assert e([{"mode": "prune_objects", "value": {"t": "p"}}])["l"] == [{"k": 2}]
    with pytest.raises(ValueError):
        e([{"mode": "shout", "path": "a"}])
    df = spark.createDataFrame([('{"a":1}',), ("broken",), (None,)], "j string")
    assert [r[0] for r in df.select(J.edited(F.col("j"), [{"mode": "set", "path": "b", "value": [1]}])).collect()] == ['{"a":1,"b":[1]}', "broken", None]


def test_negative_index_and_errors(spark):
    doc = F.lit('{"l": [{"m": 1}, {"m": 7}], "s": "x", "n": null, "b": true}')
    holds = lambda logic="OR", **c: one(spark, J.rules(doc, [c], logic))
    assert holds(path="l.-1.m", mode="full", value=7) and not holds(path="l.-2.m", mode="full", value=7)
    assert not holds(path="l.-3.m", mode="full", value=7) and holds(path="l.-3.m", mode="full", value=7, pass_missing_key=True)
    # values of other types are errors, also inverted
    assert not holds(path="s", mode="full", value=1, invert=True) and not holds(path="s", mode="gt", value=1, invert=True) and not holds(path="b", mode="full", value="x", invert=True)
    assert holds(path="n", mode="full", value=1, invert=True) and holds(path="s", mode="full", value=None, invert=True)
    assert not one(spark, J.rules(doc, [{"path": "s", "mode": "full", "value": "x"}, {"path": "s", "mode": "gt", "value": 1}]))


def test_plan_times(spark):
    at = F.lit("2025-01-31 13:05:07").cast("timestamp")
    text = lambda c: str(one(spark, c))
    assert [text(S.plan_end(at, u, n)) for u, n in (("month", 1), ("year", 1), ("day", 2), ("hour", 3), ("custom", 9))] == ["2025-03-03 13:05:07", "2026-01-31 13:05:07", "2025-02-02 13:05:07", "2025-01-31 16:05:07", "2025-01-31 13:05:16"]
    assert text(S.next_reset(at, "custom", 60)) == "2025-01-31 13:06:07" and text(S.next_reset(at, "custom")) == "None" and text(S.next_reset(at, "never")) == "None"
    assert text(S.next_reset(at, "daily", end=at)) == "None" and text(S.next_reset(at, "daily", end=F.lit(None).cast("timestamp"))) == "2025-02-01 00:00:00"
    with pytest.raises(ValueError):
        S.plan_end(at, "month", 0)


def test_divided_shown_spent(spark):
    assert one(spark, S.divided(F.lit(1), F.lit(3))) == 0.333 and one(spark, S.divided(F.lit(1), F.lit(0))) == 0.0 and one(spark, S.divided(F.lit(float("inf")), F.lit(1))) == 0.0
    assert one(spark, S.shown(F.lit(1_000_000))) == 2.0 and one(spark, S.shown(F.lit(7), "TOKENS")) == 7.0
    assert [one(spark, S.spent(F.lit(s), F.lit(e), F.lit(10), (2, 3), 1)) for s, e in ((1, 0), (1, 9), (1, 10), (3, 0))] == [False, True, False, True]
    assert one(spark, S.digest(F.lit("a"))).startswith("ca978112ca1bbdca")


def test_estimate_of_mathematical_letters():
    assert S._kind(0x1D6C1) == "math" and S._kind(0x1D400) == "word" and S._kind(0x1D7CE) == "number" and S._kind(ord("²")) == "number"
