"""Every query of the engine against its SQL, at the smallest scale."""

import oracle
import pytest

import __spark_entry__ as entry
from lexaxis.plans.registry import ORACLES, QUERIES


def test_entry_gives_one_document(spark):
    found = entry.entry(spark).collect()
    assert len(found) == 1
    assert found[0].word in found[0].text.split(" ")
    assert found[0].n_tokens == len(found[0].text.split(" "))


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, name):
    assert oracle.rows_of(QUERIES[name](spark, oracle.DATA)) == oracle.sql_rows(ORACLES[name])


def test_queries_are_logged_and_can_be_replaced(spark, caplog):
    import logging

    from lexaxis.plans.observe import hook

    with caplog.at_level(logging.INFO, logger="lexaxis.queries"):
        with hook("token_at", lambda original, *args: original(*args).selectExpr("cpos + 1 as cpos")), hook("token_at", lambda original, *args: original(*args).selectExpr("cpos * 2 as cpos")):
            assert QUERIES["token_at"](spark, oracle.DATA).first().cpos == 2470
        assert QUERIES["token_at"](spark, oracle.DATA).first().cpos == 1234
    assert sum("token_at(" in r.getMessage() for r in caplog.records) == 2
