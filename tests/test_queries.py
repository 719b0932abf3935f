"""Every registered query of the registry library against its SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from rollbook.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def plain(df, cols):
    def cell(v):
        if pd.isna(v):
            return "-"
        if isinstance(v, float) or hasattr(v, "dtype") and v.dtype.kind in "fiu" or isinstance(v, int) and not isinstance(v, bool):
            return f"{float(v):.6f}"
        return str(v)

    return sorted(tuple(cell(v) for v in row) for row in df[cols].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    if name in ORACLE_SQL:
        want = duck.execute(ORACLE_SQL[name]).df()
        cols = sorted(want.columns)
        assert sorted(got.columns) == cols
        assert plain(got, cols) == plain(want, cols)
    else:
        assert len(got) > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0 and set(QUERIES) <= set(__spark_entry__.queries())
