"""Every registered query against its SQL on whole tables, and a look at its plan."""

import glob
import math
import os

import duckdb
import pytest

from workloads import REGISTRY

# Nodes that no plan may contain, neither the last one nor those of the jobs before it.
UNWANTED = ["BatchEvalPython", "ArrowEvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"]
# Pair counting is one place for Python.
PAIR_COUNTING = ("st6", "st7", "plan_selection_report", "st15")
# Distances between points of a stripe are the other, with the numbering of stripes.
DISTANCES = ("st8_neighbour",)


def plans_since(spark, first):
    """Plans of all SQL executions from number ``first`` on, as they ran."""
    store = spark._jsparkSession.sharedState().statusStore()
    listed = store.executionsList()
    found = [listed.apply(i) for i in range(listed.size())]
    return [e.physicalPlanDescription() for e in found if e.executionId() >= first]


def next_execution(spark):
    listed = spark._jsparkSession.sharedState().statusStore().executionsList()
    return max([listed.apply(i).executionId() for i in range(listed.size())], default=-1) + 1
TYPES = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def oracle(data_dir):
    connection = duckdb.connect()
    for path in glob.glob(f"{data_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def comparable(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return (0, "")
    return (1, repr(value + 0.0) if isinstance(value, float) else str(value))


@pytest.mark.parametrize("name", list(REGISTRY))
def test_query(spark, oracle, data_dir, name):
    query = REGISTRY[name]
    first = next_execution(spark)
    result = query.run(spark, data_dir)
    columns = sorted(result.columns)
    rows = sorted(tuple(comparable(r[c]) for c in columns) for r in result.collect())
    plans = plans_since(spark, first)
    unwanted = UNWANTED if name.startswith(PAIR_COUNTING) else [*UNWANTED, "FlatMapGroupsInPandas"]
    if name.startswith(DISTANCES):
        unwanted = [n for n in UNWANTED if n != "MapInPandas"]
    assert plans and not [node for node in unwanted for plan in plans if node in plan]
    if query.sql is None:
        assert rows
        return
    wanted = oracle.sql(query.sql)
    assert sorted(wanted.columns) == columns
    types = dict(zip(wanted.columns, map(str, wanted.types)))
    assert {c: TYPES[t] for c, t in result.dtypes} == types
    places = [wanted.columns.index(c) for c in columns]
    assert rows == sorted(tuple(comparable(r[i]) for i in places) for r in wanted.fetchall())


def test_selection_query_grows_the_default_forest(spark, data_dir, monkeypatch):
    asked = []

    class Asked(Exception):
        pass

    def told(df, features, target, trees=100):
        asked.append(trees)
        raise Asked

    monkeypatch.setattr("gridloom.plans.exploration.selection_report", told)
    with pytest.raises(Asked):
        REGISTRY["plan_selection_report"].run(spark, data_dir)
    assert asked == [100]
