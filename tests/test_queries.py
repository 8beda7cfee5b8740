"""Every named query against its SQL on the smallest scale, and the driver's contract."""

import pytest

import __spark_entry__ as entry
from tools.check import compare, duck

ROOT = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


def test_contract(spark):
    assert set(SQL) <= set(entry.queries())
    flagship = entry.entry(spark)
    assert flagship.columns[:2] == ["entity_id", "window_size"] and len(flagship.columns) == 35


@pytest.fixture(scope="module")
def connection():
    return duck(ROOT)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, connection, name):
    count, _, problem = compare(spark, connection, ROOT, name)
    assert problem == ""


def test_every_window_and_every_explainer(spark):
    root = "/root/testdata/sf0.001"
    windows = entry.queries()["stream_sliding_windows"](spark, root)
    assert {r.window_size for r in windows.select("window_size").distinct().collect()} == {3600, 86400, 604800}
    day = windows.filter("window_size = 86400").drop("window_size")
    alone = entry.queries()["stream_sliding_features"](spark, root)
    assert sorted(map(str, day.collect())) == sorted(map(str, alone.collect()))
    told = entry.queries()["explain_prediction"](spark, root).select("explainer_type", "entity_id").collect()
    assert {r.explainer_type for r in told} == {"shap", "lime"}
    assert len({r.entity_id for r in told}) * 2 == len(told)
