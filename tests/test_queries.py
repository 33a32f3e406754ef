"""Every query of the library runs at the smallest scale and matches its SQL."""

import math
import os

import pytest

from ledgerline.queries import ORACLES, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    value = lambda x: None if x is None or (isinstance(x, float) and math.isnan(x)) else round(x, 6) if isinstance(x, float) else x
    return sorted(names), sorted(repr([value(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    got = plain(df.columns, df.collect())
    if name in ORACLES:
        out = duck.execute(ORACLES[name])
        names = [c[0] for c in out.description]
        assert got == plain(names, out.fetchall())
