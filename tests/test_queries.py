"""Every engine query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from tributary import queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{DATA}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + ('/*.parquet' if os.path.isdir(p) else '')}'")
    return c


def rows(frame, columns):
    return sorted(frame[columns].astype(object).where(frame[columns].notna(), None).itertuples(index=False, name=None), key=repr)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_matches_sql(spark, con, name):
    got, want = queries.QUERIES[name](spark, DATA).toPandas(), con.execute(queries.ORACLES[name]).fetchdf()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)
