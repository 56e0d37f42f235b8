"""Registered queries against their SQL, and what SQL can't express against slow versions."""

import oracle
import pytest

import __spark_entry__ as entry
from lexaxis.llm.queries import ORACLES, QUERIES


def test_one_query_for_each_operator_and_the_pipeline():
    assert [int(n[2:].split("_")[0]) for n in QUERIES if n != "pipeline"] == list(range(1, 11))
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, name):
    assert oracle.rows_of(QUERIES[name](spark, oracle.DATA)) == oracle.sql_rows(ORACLES[name])
