"""Registered queries against their SQL on the smallest tables, where those are at hand."""

import os

import duckdb
import pytest

from lattica.plans import registry

TABLES = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
#: Of each kind of plan one or two; the driver compares all.
NAMES = ("file_degrees", "edge_merge", "module_metrics", "hotspots_coupling", "tension_files", "cohesion_verdicts", "dead_exports", "blast_radius", "dependents_depth2", "process_depth", "impact_levels", "bm25_search", "search_suggestions", "pagerank_20", "betweenness")

pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables")


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(str([r[i] for i in order]) for r in rows)


def test_every_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries()) and set(NAMES) <= set(registry.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(TABLES):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{TABLES}/{f}'")
    want = con.sql(registry.oracle_sql()[name])
    got = registry.queries()[name](spark, TABLES)
    assert plain([tuple(r) for r in got.collect()], got.columns) == plain(want.fetchall(), want.columns)


def test_dead_exports_take_one_pass_and_unknown_flags(spark, tmp_path):
    lines = [(1, 10, "R"), (1, 10, "N"), (1, 11, "N"), (1, 11, None), (2, 10, None), (2, 12, "A"), (None, 12, "R"), (None, 13, "N"), (3, None, "R"), (3, None, "N"), (4, None, "N")]
    spark.createDataFrame(lines, "l_suppkey long, l_partkey long, l_returnflag string").write.parquet(str(tmp_path / "lineitem.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    got = registry.queries()["dead_exports"](spark, str(tmp_path))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, con.sql(registry.oracle_sql()["dead_exports"]).fetchall()))
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
