"""Every query with SQL gives the rows that DuckDB gives; the others run."""

import duckdb
import pytest

from tesserix.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def canonical(df):
    columns = sorted(df.columns)
    return sorted(map(repr, df[columns].astype(object).where(df[columns].notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(name, spark, sf, duck):
    df = catalogue.QUERIES[name](spark, sf)
    if name not in catalogue.ORACLE_SQL:
        assert df.count() >= 0
        return
    want = duck.sql(catalogue.ORACLE_SQL[name])
    assert {c: KINDS[t] for c, t in df.dtypes} == dict(zip(want.columns, map(str, want.types), strict=True))
    assert canonical(df.toPandas()) == canonical(want.df())
