"""Every registered query against its SQL in another engine, row by row."""

import duckdb
import pytest

from bramble.plans import catalog
from bramble.sources.tables import TABLES

KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "timestamp_ntz": "TIMESTAMP"}


@pytest.fixture(scope="module")
def other(small):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS FROM '{small}/{t}.parquet'")
    return c


def ordered(rows, names):
    at = [names.index(n) for n in sorted(names)]
    return sorted((tuple(r[i] for i in at) for r in rows), key=repr)


@pytest.mark.parametrize("key", sorted(catalog.queries()))
def test_same_rows(spark, small, other, key):
    df = catalog.queries()[key](spark, small)
    rows = [tuple(r) for r in df.collect()]
    if key not in catalog.oracle_sql():
        assert rows
        return
    told = other.sql(catalog.oracle_sql()[key])
    assert sorted(df.columns) == sorted(told.columns)
    kinds = dict(df.dtypes)
    assert {c: KINDS.get(kinds[c], kinds[c].upper()) for c in df.columns} == {c: str(t) for c, t in zip(told.columns, told.types)}
    assert ordered(rows, df.columns) == ordered(told.fetchall(), list(told.columns))


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


@pytest.mark.parametrize("key", ["anti_not_in", "tpch_q16"])
def test_not_in_needs_no_broadcast(spark, small, key):
    from bramble.plans.advisor import plan_text

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan_text(catalog.queries()[key](spark, small))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Broadcast" not in text and "LeftAnti" in text


def test_filters_and_columns_reach_the_scan(spark, small):
    from bramble.plans.advisor import plan_text

    text = plan_text(catalog.queries()["scan_pushdown"](spark, small))
    assert "PushedFilters: [IsNotNull" in text and "GreaterThan(l_quantity,45.0)" in text
    schema = next(x for x in text.splitlines() if "ReadSchema" in x)
    assert "l_extendedprice" not in schema and "l_shipdate" not in schema
