"""Projects of which no day matches, as on large tables, where each day loses some row: nothing is profiled."""

import duckdb
import pytest

from ledgerline.queries import ORACLES, QUERIES

#: A multiple of every key that the queries drop.
K = 400 * 211 * 97 * 53 * 37 * 3


@pytest.fixture(scope="module")
def orders(tmp_path_factory):
    """Three orders on each of 400 days: one that the right sides drop, one that a left side drops, and one more."""
    at = tmp_path_factory.mktemp("orders")
    days = "SELECT i, k, row_number() OVER () AS c, TIMESTAMP '1995-06-01' + to_days(CAST(i AS INTEGER)) AS day FROM range(400) a(i), (VALUES (0), (1), (10)) b(k)"
    duckdb.sql(f"COPY (SELECT i * {K} + k AS o_orderkey, c AS o_custkey, 'F' AS o_orderstatus, 1.5 AS o_totalprice, day AS o_orderdate, '5-LOW' AS o_orderpriority FROM ({days})) TO '{at}/orders.parquet'")
    return at


@pytest.mark.parametrize("name", ["g_project_latest", "g_project_number", "g_project_shared", "g_project_text", "g_project_transform"])
def test_nothing_is_profiled(spark, orders, name):
    got = QUERIES[name](spark, str(orders))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW orders AS SELECT * FROM '{orders}/orders.parquet'")
    want = duck.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLES[name]})").fetchall()
    assert want and all("columns" not in r for r in want)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_lists_without_dates_are_null(spark, orders):
    """Of r_matching_dates: no date matches, as string_agg over no rows is null."""
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW orders AS SELECT * FROM '{orders}/orders.parquet'")
    got = QUERIES["r_matching_dates"](spark, str(orders))
    want = duck.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLES['r_matching_dates']})").fetchall()
    assert want[0][0] is None and [tuple(r) for r in got.collect()] == want


def test_keys_of_odd_numbers(spark, tmp_path):
    """Of x_match_key: a balance of negative zero, and those that are no finite number."""
    duck = duckdb.connect()
    duck.execute("CREATE TABLE customer AS SELECT row_number() OVER () AS c_custkey, CAST(v AS DOUBLE) AS c_acctbal, 'A' AS c_mktsegment FROM (VALUES ('-0.0'), ('0.0'), ('-0.00001'), ('0.00001'), ('-12.5'), ('nan'), ('inf'), ('-inf'), (NULL)) t(v)")
    duck.execute(f"COPY customer TO '{tmp_path}/customer.parquet'")
    got = QUERIES["x_match_key"](spark, str(tmp_path))
    want = duck.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLES['x_match_key']})").fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
