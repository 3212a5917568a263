"""Every registered query of the core runs; those with SQL give the same rows as DuckDB."""

import duckdb
import pandas as pd
import pytest

from pointweave import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(pdf, cols):
    plain = lambda v: None if v is None or v is pd.NA or v != v else float(v) if isinstance(v, int | float) and not isinstance(v, bool) else str(v) if not hasattr(v, "dtype") else v.item()
    return sorted((tuple(plain(v) for v in row) for row in pdf[cols].astype(object).values.tolist()), key=str)


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows_as_sql(spark, sf_dir, duck, name):
    mine, theirs = registry.QUERIES[name](spark, sf_dir).toPandas(), duck.execute(registry.ORACLE_SQL[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows_of(mine, sorted(mine.columns)) == rows_of(theirs, sorted(mine.columns))


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_kernel_queries_run(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0
