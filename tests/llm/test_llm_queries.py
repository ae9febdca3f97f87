"""Every query of this subpackage that SQL can express, against that SQL on whole tables."""

import glob
import os

import duckdb
import pytest

from gridloom.llm.queries import QUERIES


@pytest.fixture(scope="module")
def oracle(data_dir):
    connection = duckdb.connect()
    for path in glob.glob(f"{data_dir}/*.parquet"):
        connection.sql(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", [k for k, q in QUERIES.items() if q.sql])
def test_query(spark, oracle, data_dir, name):
    result = QUERIES[name].run(spark, data_dir)
    wanted = oracle.sql(QUERIES[name].sql)
    assert sorted(wanted.columns) == sorted(result.columns)
    types = {"bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN"}
    assert {c: types[t] for c, t in result.dtypes} == dict(zip(wanted.columns, map(str, wanted.types)))
    places = [wanted.columns.index(c) for c in result.columns]
    assert sorted(map(tuple, result.collect())) == sorted(tuple(r[i] for i in places) for r in wanted.fetchall())


def test_names():
    assert {int(k[2:].split("_")[0]) for k in QUERIES} == set(range(1, 14))
