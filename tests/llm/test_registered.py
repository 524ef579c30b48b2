"""Registered text queries against their SQL statements on the smallest tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from braidset.llm.queries import ORACLES, QUERIES

SF_DIR = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", list(ORACLES))
def test_statement(spark, name):
    con = duckdb.connect()
    for file in glob.glob(f"{SF_DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(file)[:-8]} AS SELECT * FROM '{file}'")
    answer = con.execute(ORACLES[name])
    columns = [d[0] for d in answer.description]
    df = QUERIES[name](spark, SF_DIR)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == sorted(map(repr, answer.fetchall()))


def test_thirteen_queries_are_registered():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)]
