"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

import stated_rows
from nomena.plans import dated, forms, registry, retrieval  # noqa: F401  # the others add theirs

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(found):
    plain = lambda x: round(float(x), 9) if isinstance(x, float) or type(x).__name__ == "Decimal" else x
    return sorted((tuple(map(plain, r)) for r in found), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", list(registry.ORACLE_SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    same(con, registry.QUERIES[name](spark, SF), registry.ORACLE_SQL[name])


@pytest.mark.parametrize("name", list(stated_rows.ORACLE_SQL))
def test_stated_rows(spark, name):
    """Small rows that reach every branch."""
    same(duckdb.connect(), stated_rows.QUERIES[name](spark, SF), stated_rows.ORACLE_SQL[name])


def same(con, df, sql):
    columns = sorted(df.columns)
    want = con.sql("select " + ", ".join(f'"{c}"' for c in columns) + f" from ({sql})").fetchall()
    assert rows(df.select(columns).collect()) == rows(want)
