"""Every registered query against DuckDB on the same parquet files."""

import pytest

import __spark_entry__ as contract
from driver_tables import TESTDATA

QUERIES = contract.ledger_queries()
ORACLE = contract.ledger_oracle_sql()


def canonical(columns, rows):
    names = sorted(columns)
    positions = [columns.index(n) for n in names]
    return names, sorted((tuple(row[p] for p in positions) for row in rows), key=repr)


@pytest.fixture(scope="module")
def oracle(duck):
    return duck("0.01")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, oracle, name):
    result = QUERIES[name](spark, f"{TESTDATA}/sf0.01")
    columns, rows = canonical(result.columns, [tuple(r) for r in result.collect()])
    answer = oracle.execute(ORACLE[name])
    expected_columns, expected = canonical(
        [d[0] for d in answer.description], answer.fetchall()
    )
    assert columns == expected_columns
    assert len(rows) == len(expected) > 0
    assert rows == expected
    kinds = {type(cell) for row in expected for cell in row}
    assert {type(cell) for row in rows for cell in row} == kinds


def test_every_query_has_an_oracle():
    assert QUERIES.keys() == ORACLE.keys()


def test_entry(spark):
    assert contract.entry(spark).count() == 12
