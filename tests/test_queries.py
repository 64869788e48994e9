"""Every registered query of the library against its SQL."""

from __future__ import annotations

import pytest

import __spark_entry__
from millrace import catalog

from .oracle import spark_rows, sql_rows

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, name):
    got_names, got = spark_rows(QUERIES[name](spark, sf))
    names, want = sql_rows(SQL[name], sf)
    assert got_names == names
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


@pytest.mark.parametrize("most", [None, 0])
def test_functions_are_not_dealt_out_by_few_names(spark, sf, monkeypatch, most):
    """Functions that share few names stay where they are; with too many names to send along the rows are the same."""
    from millrace.operators import link

    if most is not None:
        monkeypatch.setattr(link, "BROADCAST_ROWS", most)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = QUERIES["wildcard_link"](spark, sf)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert ("hashpartitioning(project" in plan) == (most == 0)
        assert spark_rows(df) == sql_rows(SQL["wildcard_link"], sf)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_names_agree():
    assert set(SQL) <= set(QUERIES)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
