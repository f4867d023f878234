"""Every query on text corpora with SQL gives what DuckDB gives on the same tables."""

import os
from collections import Counter

import duckdb
import pytest

from meterlark.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, data, name):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(data):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{data}/{f}'")
    df = QUERIES[name](spark, data)
    q = c.execute(SQL[name])
    names = [d[0] for d in q.description]
    assert sorted(names) == sorted(df.columns)
    mine = Counter(tuple(r[n] for n in names) for r in df.collect())
    assert mine == Counter(map(tuple, q.fetchall())) and mine


def test_masked_files_hold_no_credential(spark, data):
    """What p1_credentials finds is nowhere in what p1_masked gives, byte by byte."""
    hidden = {r["file_id"]: r["body"] for r in QUERIES["p1_masked"](spark, data).collect()}
    bodies = {r["file_id"]: r["body"] for r in spark.read.parquet(f"{data}/config_file.parquet").collect()}
    assert hidden.keys() == bodies.keys()
    found = QUERIES["p1_credentials"](spark, data).collect()
    for r in found:
        secret = bodies[r["file_id"]].encode()[r["from_byte"] : r["to_byte"]].decode()
        if r["kind"] != "key_block":
            assert secret.strip() not in hidden[r["file_id"]]
    touched = {r["file_id"] for r in found}
    assert touched and all(hidden[k] == b for k, b in bodies.items() if k not in touched)


def test_replaced_texts_hold_no_detail(spark, data):
    new = {(r["src"], r["row_id"]): r["text"] for r in QUERIES["p3_replaced"](spark, data).collect()}
    found = QUERIES["p3_details"](spark, data).collect()
    kinds: dict = {}
    for r in found:
        kinds.setdefault((r["src"], r["row_id"]), []).append(r["kind"])
        if r["kind"] in ("email", "phone", "id_number"):
            assert r["value"] not in new[r["src"], r["row_id"]]
    for k, names in kinds.items():
        assert all(new[k].count(f"[{n.upper()}]") >= names.count(n) for n in names)
