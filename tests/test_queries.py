"""Each query against its SQL twin at the smallest scale."""

import math

import duckdb
import pytest

from loomrank import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 4)
    return v.replace(tzinfo=None).isoformat() if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", catalog.oracle_sql())
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    other = con.sql(catalog.oracle_sql()[name])
    assert sorted(other.columns) == cols
    theirs = sorted((tuple(plain(dict(zip(other.columns, x, strict=True))[c]) for c in cols) for x in other.fetchall()), key=repr)
    assert mine == theirs


def test_flagship(spark):
    rows = catalog.flagship(spark, SF).collect()
    assert 0 < len(rows) <= 100 and all(a.score >= b.score for a, b in zip(rows, rows[1:]))
