"""Registered queries on the smallest tables, against DuckDB where there is a twin."""

import os

import duckdb
import numpy as np
import pytest

import __spark_entry__
from tessera.llm.queries import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_twins(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df = QUERIES[name](spark, SF)
    twin = con.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(twin.columns)
    assert sorted(tuple(r) for r in df.collect()) == sorted(twin.select(*df.columns).fetchall())


def test_recall(spark):
    e = duckdb.sql(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet' ORDER BY vec_id").fetchall()
    ids, x = np.array([r[0] for r in e]), np.array([r[1] for r in e])
    near = {}
    for r in QUERIES["op8_nearest_neighbours"](spark, SF).collect():
        near.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        s[i] = -9
        hits += len(near[ids[i]] & set(ids[np.lexsort((ids, -s))[:20]].tolist()))
    assert hits >= 0.9 * 20 * (ids % 20 == 0).sum()


def test_all_are_registered():
    names = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 11)} <= {k.split("_")[0] for k in names} and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)
