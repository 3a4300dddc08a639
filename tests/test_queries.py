"""Every registered query of the library against its DuckDB twin, on the smallest tables."""

import duckdb
import pytest

from compare import TABLES, rows_of
from graphloom import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    cur = con.execute(queries.ORACLE[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, cur.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(queries.ORACLE) <= set(__spark_entry__.oracle_sql()) and set(queries.QUERIES) <= set(__spark_entry__.queries())


def test_louvain_is_stable_and_finds_regions(spark):
    one, two = (sorted(queries.QUERIES["louvain"](spark, SF).collect()) for _ in range(2))
    assert one == two
    region = {f"n:{r['n_nationkey']:02d}": r["n_regionkey"] for r in spark.read.parquet(f"{SF}/nation.parquet").collect()}
    assert len({(r["community"], region[r["id"]]) for r in one}) == len({r["community"] for r in one}) == len(set(region.values()))
