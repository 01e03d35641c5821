import duckdb
import pytest

from bramble.llm import catalog


def test_names():
    assert sorted(int(k[2:].split("_")[0]) for k in catalog.queries()) == list(range(1, 11))


@pytest.mark.parametrize("key", sorted(catalog.oracle_sql()))
def test_same_rows(spark, small, key):
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.sql(f"CREATE VIEW {t} AS FROM '{small}/{t}.parquet'")
    told = c.sql(catalog.oracle_sql()[key])
    got = catalog.queries()[key](spark, small)
    names = list(told.columns)
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*names).collect()), key=repr) == sorted(told.fetchall(), key=repr)
