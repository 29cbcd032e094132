"""Every registered query of the engine against its SQL on the smallest tables, or non-empty if it has none."""

from __future__ import annotations

import duckdb
import pytest
from compare import TABLES, canon
from quarry.operators import recommend
from quarry.plans import catalog

SMALL = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    got = QUERIES[name](spark, SMALL)
    if name in SQL:
        got, want = canon(got.toPandas()), canon(db.execute(SQL[name]).fetchdf())
        assert list(got.columns) == list(want.columns)
        assert got.equals(want)
    else:
        assert got.limit(1).count() == 1 or name in ("mllib_minhash", "fuzzy_pairs")


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.fixture(scope="module")
def repeated(tmp_path_factory):
    """Tables whose customers have 1 to 14 copies, of equal baskets."""
    folder = tmp_path_factory.mktemp("repeated")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    orders, lines = f"read_parquet('{SMALL}/orders.parquet')", f"read_parquet('{SMALL}/lineitem.parquet')"
    con.execute(f"CREATE TABLE orders AS SELECT * REPLACE (o_orderkey + 100000 * g AS o_orderkey, o_custkey + 1000 * g AS o_custkey) FROM {orders}, range(14) r(g) WHERE g <= o_custkey % 14")
    con.execute(f"CREATE TABLE lineitem AS SELECT l.* REPLACE (l_orderkey + 100000 * g AS l_orderkey) FROM {lines} l JOIN {orders} ON o_orderkey = l_orderkey, range(14) r(g) WHERE g <= o_custkey % 14")
    con.execute(f"CREATE TABLE part AS FROM read_parquet('{SMALL}/part.parquet')")
    for t in ("orders", "lineitem", "part"):
        con.execute(f"COPY {t} TO '{folder}/{t}.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", ["user_cf_topk", "ranking_metrics", "bootstrap_precision", "hybrid_topk"])
def test_equal_baskets_are_scored_twice_at_most(spark, repeated, monkeypatch, name):
    folder, con = repeated
    rank, ranked = recommend.top_k, []
    monkeypatch.setattr(recommend, "top_k", lambda scores, k: ranked.append(scores.select("user").distinct().count()) or rank(scores, k))
    got = QUERIES[name](spark, folder)
    if name in SQL:
        got, want = canon(got.toPandas()), canon(con.execute(SQL[name]).fetchdf())
        assert len(got) and got.equals(want)
    else:
        assert got.select("user").distinct().count() == con.execute("SELECT count(DISTINCT o_custkey) FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderdate < '2000-01-01'").fetchone()[0]
    assert ranked and 0 < max(ranked) <= 2 * con.execute("SELECT count(DISTINCT o_custkey) FROM orders WHERE o_custkey < 1000").fetchone()[0]
