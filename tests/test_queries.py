"""Every query with SQL against DuckDB over the same tables."""

import duckdb
import pytest

import __spark_entry__

ORACLE = __spark_entry__.oracle_sql()


def canonical(df):
    df = df[sorted(df.columns)]
    return sorted(str(tuple(None if v is None or v != v else float(v) if isinstance(v, (int, float)) or hasattr(v, "dtype") else v for v in r)) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, sf_dir, duck, name):
    assert canonical(__spark_entry__.queries()[name](spark, sf_dir).toPandas()) == canonical(duck.sql(ORACLE[name]).df())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(ORACLE) <= set(__spark_entry__.queries())
