"""Every registered query against its SQL statement on the smallest tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from __spark_entry__ import entry
from braidset.catalog.oracles import ORACLES
from braidset.catalog.queries import QUERIES

SF_DIR = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for file in glob.glob(f"{SF_DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(file)[:-8]} AS SELECT * FROM '{file}'")
    return con


def plain(value):
    return repr(round(value, 6)) if isinstance(value, float) else repr(value)


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, database, name):
    df = QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert name in ORACLES, "every query has a statement"
    answer = database.execute(ORACLES[name])
    kinds = {d[0]: str(d[1]) for d in answer.description}
    assert {f.name: KINDS[f.dataType.simpleString()] for f in df.schema.fields} == kinds
    order = [list(kinds).index(c) for c in columns]
    assert rows == sorted(tuple(plain(r[i]) for i in order) for r in answer.fetchall())


def test_entry(spark):
    assert entry(spark).count() > 0


def test_no_statement_without_a_query():
    assert set(ORACLES) == set(QUERIES)
