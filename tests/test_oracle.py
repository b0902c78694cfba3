"""Every registered query against its SQL counterpart."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from outletscope.plans.oracle import ORACLE
from outletscope.plans.queries import QUERIES


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLE) <= set(contract.oracle_sql())


SQL_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(name, spark, duck):
    directory = "/root/testdata/sf0.01"
    df = QUERIES[name](spark, directory)
    names = sorted(df.columns)
    connection = duck(directory)
    described = connection.execute("DESCRIBE " + ORACLE[name]).fetchall()
    assert {c[0]: c[1] for c in described} == {n: SQL_TYPES[t] for n, t in df.dtypes}
    result = connection.execute(ORACLE[name])
    order = [[c[0] for c in result.description].index(n) for n in names]
    expected = sorted((tuple(row[i] for i in order) for row in result.fetchall()), key=repr)
    got = sorted((tuple(row[n] for n in names) for row in df.collect()), key=repr)
    assert got == expected
    assert got, "a check on no rows shows nothing"


def test_entry_has_seven_rows_per_outlet(spark):
    card = contract.entry(spark)
    assert card.columns[0] == "outlet_id"
    counts = {r["outlet_id"]: r["count"] for r in card.groupBy("outlet_id").count().collect()}
    assert len(counts) == 25 and set(counts.values()) == {7}
