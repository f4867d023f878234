"""Credentials in whole files, key paths of formats, and the scan of lines with a cue against that of everything."""

import ast
import json

import pytest
from hypothesis import given, settings, strategies as st

from meterlark.llm import credentials as C, formats
from heldout_credentials import CLEAN, SECRETS


def lines(text, spans=None):
    hits = C.find(text, spans)
    return set(C._lines(text, hits))


@pytest.mark.parametrize(("text", "want"), SECRETS)
def test_heldout_secrets(text, want):
    assert lines(text) == want
    hidden = C.mask(text)
    assert not C.find(hidden) and hidden.count("\n") == text.count("\n")


@pytest.mark.parametrize("text", CLEAN)
def test_heldout_clean(text):
    assert C.find(text) == []


PIECES = ["password", "İ", "\n", ": ", "=", '"', "'", "hunter2Secret9", " ", "token", "Key", "\t", "api_", "K", "value", "{", "}", "- ", "[auth]", "#", "://u:Pw9xyzA@h", "$X", "ſecret", ";"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=16).map("".join))
def test_lines_with_a_cue_are_enough(text):
    assert C.find(text) == C.find(text, [(0, len(text))])


def test_one_letter_more_changes_nothing():
    text = '"password"\n: "hunter2Secret9"\n'
    assert lines(text) == {2} and lines("# İ\n" + text) == {3} == lines("# i\n" + text)


def test_masks_keep_files_valid(spark, data):
    for r in spark.read.parquet(f"{data}/config_file.parquet").filter("body IS NOT NULL").collect():
        hidden = C.mask(r["body"])
        for end, read in ((".json", json.loads), (".py", ast.parse)):
            if (r["path"] or "").endswith(end):
                try:
                    read(r["body"])
                except (ValueError, SyntaxError):
                    continue
                read(hidden)
        assert hidden.count('\n') == r['body'].count('\n')


def test_masks_of_numbers_and_inner_strings():
    assert C.mask('{"password": 12345678, "n": 1}') == '{"password": 0, "n": 1}'
    assert C.mask('c = "Server=x;Pwd=s3cretPw;Timeout=5"') == 'c = "Server=x;Pwd=REDACTED;Timeout=5"'
    assert C.mask("db:\n  password: Zebra9Crossing # old\n") == "db:\n  password: REDACTED # old\n"
    assert C.mask('<add key="DbPassword" value="hunter2Secret9"/>') == '<add key="DbPassword" value="REDACTED"/>'


def paths(text):
    return [(".".join(e.path), e.value) for e in formats.entries(text)]


def test_key_paths():
    assert paths('{"db": {"primary": {"password": "x"}}, "l": [{"a": 1}, [true]]}') == [("db.primary.password", "x"), ("l.0.a", "1"), ("l.1.0", "true")]
    assert paths("a:\n  b: x # c\n  l:\n  - 1\n  - k: 'it''s'\n    m: {p: q}\nc: |\n  t\n   u\nd: \"e\\n\"\n") == [("a.b", "x"), ("a.l.0", "1"), ("a.l.1.k", "it's"), ("a.l.1.m.p", "q"), ("c", "t\n   u"), ("d", "e\n")]
    assert paths('<a><b c="1">t &lt;</b><add key="K" value="v"/><!-- <p>no</p> --></a>') == [("a.b.c", "1"), ("a.b", "t <"), ("a.add.K.value", "v")]
    assert formats.kind("x = 1\ny = 2") == "" and formats.entries("") == []


@settings(max_examples=100, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(st.characters(exclude_categories=["Cs"])), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(st.characters(exclude_categories=["Cs"])), x, max_size=4), max_leaves=12))
def test_json_values(value):
    def walk(v, path=()):
        if isinstance(v, dict):
            for k, x in v.items():
                yield from walk(x, (*path, k))
        elif isinstance(v, list):
            for i, x in enumerate(v):
                yield from walk(x, (*path, str(i)))
        else:
            yield path, v

    text = json.dumps(value)
    got = list(formats.json_values(text))
    assert [e.path for e in got] == [p for p, _ in walk(value)]
    for e, (_, v) in zip(got, walk(value)):
        assert json.loads(f'"{text[e.start:e.end]}"' if e.style == "quoted" else text[e.start : e.end]) == v


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab:- \n{}[],\"'#|>&!<=/k", max_size=60))
def test_any_text_is_read(text):
    for parse in (formats.json_values, formats.yaml_values, formats.xml_values):
        for e in parse(text):
            assert 0 <= e.start <= e.end <= len(text)
    C.mask(text)
