"""Every registered query that has SQL, against DuckDB on the smallest tables."""

import duckdb
import pytest

from millrace.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return repr(round(value, 6) + 0.0)
    if isinstance(value, list | tuple):
        return [plain(v) for v in value]
    return repr(value)


def rows_of(columns, rows):
    return sorted(tuple(map(str, (plain(r[c]) for c in columns))) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_duckdb(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    found = duck.sql(registry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(found.columns)
    want = [dict(zip(found.columns, r, strict=True)) for r in found.fetchall()]
    assert rows_of(columns, [r.asDict() for r in df.collect()]) == rows_of(columns, want)


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
