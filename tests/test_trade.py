"""The trade graph holds all pairs, and the queries over it and over its main partners agree with their SQL."""

import os

import duckdb
import pytest

from lattica.plans import registry
from lattica.sources import bindings

from .test_registry import TABLES, plain

pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables")


def tables():
    con = duckdb.connect()
    for f in os.listdir(TABLES):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{TABLES}/{f}'")
    return con


def test_no_pair_is_dropped(spark):
    pairs = tables().sql("SELECT count(DISTINCT (c_nationkey, s_nationkey)) FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey").fetchall()[0][0]
    assert bindings.trade(spark, TABLES).edges.count() == pairs > 50
    assert bindings.trade(spark, TABLES, 2).edges.count() <= 50


@pytest.mark.parametrize("name", [*(f"{x}_top_partners" for x in ("file_degrees", "pagerank_20", "betweenness", "bridge_files", "cycle_members")), "pagerank_20_parts", "blast_radius_parts", "cycle_members_parts", "changed_affected"])
def test_query_agrees_with_sql(spark, name):
    want = tables().sql(registry.oracle_sql()[name])
    got = registry.queries()[name](spark, TABLES)
    assert plain([tuple(r) for r in got.collect()], got.columns) == plain(want.fetchall(), want.columns)
