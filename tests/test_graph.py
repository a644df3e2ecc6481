"""Small hand-made graphs with known results."""

import math

import pytest

from lattica.operators import calls, cycles, iterate, metrics, search
from lattica.plans import queries as q
from lattica.plans.graph import SCHEMAS, build_graph


def facts(spark, files, exports=(), imports=(), sites=()):
    file_rows = [(p, loc, churn, ".test." in p, test, i) for i, (p, loc, churn, test) in enumerate(files)]
    export_rows = [(f, n, k, loc, d, c, i) for i, (f, n, k, loc, d, c) in enumerate(exports)]
    import_rows = [(f, r, s, t, i) for i, (f, r, s, t) in enumerate(imports)]
    site_rows = [(*s, "type-resolved", i) for i, s in enumerate(sites)]
    make = lambda rows, name: spark.createDataFrame(rows, SCHEMAS[name])
    return build_graph(make(file_rows, "files"), make(export_rows, "exports"), make(import_rows, "imports"), make(site_rows, "call_sites"))


@pytest.fixture(scope="module")
def app(spark):
    files = [("api/a.ts", 10, 3, None), ("api/b.ts", 20, 0, None), ("core/c.ts", 30, 1, "core/c.test.ts"), ("core/c.test.ts", 5, 0, None), ("main.ts", 7, 9, None)]
    exports = [
        ("api/a.ts", "getA", "function", 4, False, 3), ("api/a.ts", "unusedA", "function", 2, False, 1), ("api/b.ts", "B", "class", 9, True, 2),
        ("core/c.ts", "Core", "class", 9, False, 5), ("core/c.ts", "limit", "variable", 1, False, 0), ("core/c.ts", "deadFn", "function", 1, False, 1),
    ]
    imports = [
        ("main.ts", "api/a.ts", ["getA"], False), ("main.ts", "api/b.ts", ["default"], True), ("api/a.ts", "core/c.ts", ["Core"], True),
        ("api/a.ts", "core/c.ts", ["limit", "Core"], False), ("api/b.ts", "core/c.ts", ["Core"], False), ("core/c.ts", "api/a.ts", [], True),
        ("api/b.ts", "api/b.ts", ["B"], False), ("api/b.ts", "node_modules/x.ts", ["x"], False),
    ]
    sites = [("main.ts", "<module>", "api/a.ts", "getA"), ("api/a.ts", "getA", "core/c.ts", "Core.run"), ("api/b.ts", "B.go", "core/c.ts", "Core.run"), ("core/c.ts", "Core.run", "node_modules/z.ts", "z")]
    return facts(spark, files, exports, imports, sites).pinned()


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_edges_merge_and_test_edges(app):
    got = {(r["source"], r["target"]): r for r in app.edges.collect()}
    merged = got["api/a.ts", "core/c.ts"]
    assert merged["symbols"] == ["Core", "limit"] and merged["weight"] == 2 and merged["is_type_only"] is False
    assert got["core/c.ts", "api/a.ts"]["weight"] == 1
    assert got["core/c.test.ts", "core/c.ts"]["symbols"] == ["tests"]
    assert len(got) == 6  # no self import, nothing outside


def test_symbols_and_calls(app):
    ids = {r["id"]: r for r in app.symbols.collect()}
    assert ids["core/c.ts::Core.run"]["loc"] == 0 and ids["main.ts::<module>"]["kind"] == "function"
    assert "core/c.ts::limit" not in ids
    assert rows(app.call_edges, "source", "target")[0] == ("api/a.ts::getA", "core/c.ts::Core.run")
    assert app.call_edges.count() == 3


def test_degrees_and_coupling(app):
    got = {r["path"]: r for r in metrics.degrees(app.files, app.edges).collect()}
    assert (got["core/c.ts"]["fan_in"], got["core/c.ts"]["fan_out"]) == (3, 1)
    assert got["main.ts"]["coupling"] == pytest.approx(2 / 3) and got["core/c.ts"]["coupling"] == pytest.approx(1 / 4)


def test_dead_exports(app):
    a = q.Analysis(app)
    assert rows(a.dead, "file", "name") == [("api/a.ts", "unusedA"), ("core/c.ts", "deadFn")]
    got = q.dead_exports(a)
    assert got["total"].first()[0] == 2
    assert [(r["path"], r["dead_exports"], r["total_exports"]) for r in got["files"].collect()] == [("api/a.ts", ["unusedA"], 2), ("core/c.ts", ["deadFn"], 2)]
    assert q.dead_exports(a, "core/")["total"].first()[0] == 1


def test_blast_radius_counts_itself_on_a_cycle(app):
    got = dict(rows(iterate.blast_radius(app.files, app.edges), "path", "blast_radius"))
    assert got["api/a.ts"] == 5 and got["main.ts"] == 0 and got["core/c.ts"] == 5


def test_dependents(app):
    got = q.dependents(q.Analysis(app), "core/c.ts", 2)
    assert got["summary"].first()["total_affected"] == 4 and got["summary"].first()["risk_level"] == "LOW"
    assert [(r["path"], r["through"], r["depth"]) for r in got["transitive"].collect()] == [("main.ts", ["core/c.ts", "api/a.ts"], 2)]
    with pytest.raises(q.NotFound):
        q.dependents(q.Analysis(app), "nope.ts")


def test_module_metrics(app):
    got = {r["path"]: r for r in metrics.module_metrics(app).collect()}
    assert (got["core/"]["internal_deps"], got["core/"]["external_deps"]) == (1, 1) and got["core/"]["cohesion"] == 0.5
    assert got["."]["depends_on"] == ["api/"] and got["api/"]["depended_by"] == [".", "core/"]


def test_verdicts_tension_and_summary(app):
    verdicts = dict(rows(metrics.cohesion_verdicts(app.files, metrics.module_metrics(app)), "path", "verdict"))
    assert verdicts == {".": "LEAF", "api/": "JUNK_DRAWER", "core/": "LEAF"}
    tension = {r["file"]: r for r in metrics.tension_files(app).collect()}
    # api/a.ts: core pulls 2 + 0.5, the root 0.5
    p = [2.5 / 3, 0.5 / 3]
    want = -sum(x * math.log(x) for x in p) / math.log(2)
    assert tension["api/a.ts"]["tension"] == math.floor(want * 100 + 0.5) / 100
    assert [x["module"] for x in tension["api/a.ts"]["pulled_by"]] == ["core/", "."]
    text = q.forces(q.Analysis(app))["summary"].first()[0]
    assert text.startswith("1 junk-drawer module(s) (api/)")


def test_groups_and_overview(app):
    a = q.Analysis(app)
    assert {r["name"] for r in q.groups(a).collect()} == {"API", "CORE", "ROOT"}
    totals = q.overview(a)["totals"].first()
    assert (totals["total_files"], totals["total_functions"], totals["total_dependencies"], totals["max_depth"], totals["circular_deps"]) == (5, 5, 6, 2, 1)
    assert totals["avg_loc"] == 14


def test_cycles(spark, app):
    got = cycles.circular_dependencies(app.files, app.edges).collect()
    assert [(r["cycle"], r["severity"]) for r in got] == [(["api/a.ts", "core/c.ts", "api/a.ts"], "LOW")]


def brute_cycles(nodes, out, most=100):
    seen, found = set(), []

    def visit(n, path):
        seen.add(n)
        for m in out.get(n, []):
            if m in path:
                found.append([*path[path.index(m) :], m])
            elif m not in seen:
                visit(m, [*path, m])

    for n in nodes:
        if n not in seen:
            visit(n, [n])
    keep, keys = [], set()
    for c in found[:most]:
        ring = c[:-1]
        i = ring.index(min(ring))
        key = tuple(ring[i:] + ring[:i])
        if key not in keys:
            keys.add(key)
            keep.append(c)
    return keep


@pytest.mark.parametrize("seed", [1, 2])
def test_cycles_match_a_full_search(spark, seed):
    import random

    r = random.Random(seed)
    names = [f"m/f{i}.ts" for i in range(12)]
    pairs = sorted({(r.choice(names), r.choice(names)) for _ in range(22)} - {(n, n) for n in names})
    r.shuffle(pairs)
    g = facts(spark, [(n, 1, 0, None) for n in names], imports=[(a, b, ["x"], False) for a, b in pairs])
    out = {}
    for a, b in pairs:
        out.setdefault(a, []).append(b)
    assert [x["cycle"] for x in cycles.circular_dependencies(g.files, g.edges).orderBy("rank").collect()] == brute_cycles(names, out)


def test_pagerank_sums_to_one(app):
    ids = app.files.selectExpr("path AS id")
    got = dict(rows(iterate.pagerank(ids, app.edges), "id", "page_rank"))
    assert sum(got.values()) == pytest.approx(1.0) and max(got, key=got.get) in ("core/c.ts", "api/a.ts")


def brute_betweenness(nodes, edges):
    from collections import deque

    score = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        order, parents, sigma, dist = [], {n: [] for n in nodes}, dict.fromkeys(nodes, 0), {s: 0}
        sigma[s] = 1
        todo = deque([s])
        while todo:
            v = todo.popleft()
            order.append(v)
            for a, w in edges:
                if a == v:
                    if w not in dist:
                        dist[w] = dist[v] + 1
                        todo.append(w)
                    if dist[w] == dist[v] + 1:
                        sigma[w] += sigma[v]
                        parents[w].append(v)
        dep = dict.fromkeys(nodes, 0.0)
        for w in reversed(order):
            for v in parents[w]:
                dep[v] += sigma[v] / sigma[w] * (1 + dep[w])
            if w != s:
                score[w] += dep[w]
    n = len(nodes)
    return {k: v / ((n - 1) * (n - 2)) for k, v in score.items()}


def test_betweenness(spark):
    import random

    r = random.Random(5)
    nodes = list("abcdefgh")
    edges = sorted({(r.choice(nodes), r.choice(nodes)) for _ in range(16)} - {(n, n) for n in nodes})
    got = iterate.betweenness(spark.createDataFrame([(n,) for n in nodes], "id string"), spark.createDataFrame(edges, "source string, target string"))
    want = brute_betweenness(nodes, edges)
    for k, v in rows(got, "id", "betweenness"):
        assert v == pytest.approx(want[k])


def test_clusters_cover_every_file(spark):
    block = lambda p: [(f"{p}/{a}.ts", f"{p}/{b}.ts", ["x"], False) for a in "abcd" for b in "abcd" if a < b]
    names = [f"{p}/{x}.ts" for p in ("m", "n") for x in "abcd"] + ["lone.ts"]
    g = facts(spark, [(n, 1, 0, None) for n in names], imports=[*block("m"), *block("n"), ("m/a.ts", "n/a.ts", ["x"], False)])
    got = cycles.clusters(g.files, g.edges).collect()
    assert sorted(f for r in got for f in r["files"]) == sorted(names)
    assert {tuple(r["files"]) for r in got} == {tuple(f"{p}/{x}.ts" for x in "abcd") for p in ("m", "n")} | {("lone.ts",)}
    by = {r["name"]: r for r in got}
    assert by["m/"]["cohesion"] == pytest.approx(6 / 7) and by["n/"]["cohesion"] == 1.0 and by["."]["cohesion"] == 1.0
    assert [r["file_count"] for r in q.clusters(q.Analysis(g), 2).collect()] == [4, 4]


def test_processes_and_impact(app):
    got = {r["entry_id"]: r for r in calls.processes(app.symbols, app.call_edges).collect()}
    assert got["main.ts::<module>"]["depth"] == 2 and got["main.ts::<module>"]["modules_touched"] == ["api", "core", "main.ts"]
    a = q.Analysis(app)
    assert [(r["depth"], r["risk"], r["symbol"]) for r in q.impact(a, "Core.run").collect()] == [(1, "WILL BREAK", "getA"), (1, "WILL BREAK", "B.go"), (2, "LIKELY", "<module>")]
    assert q.impact(a, "a::getA").count() == 1 and q.impact(a, "A.getA").count() == 1
    with pytest.raises(q.NotFound):
        q.impact(a, "nobody")
    assert q.processes(a, "MODULE").first()["name"] == "<module>" and q.processes(a, limit=1).count() == 1


def test_rename_and_symbol(app):
    a = q.Analysis(app)
    assert rows(q.rename(a, "Core", "Kernel"), "file", "confidence") == [("api/a.ts", "text-inferred"), ("api/b.ts", "text-inferred"), ("core/c.ts", "type-resolved")]
    got = q.symbol_context(a, "getA")
    assert got["symbol"].first()["fan_in"] == 1 and [r["symbol"] for r in got["callers"].collect()] == ["<module>"]
    assert [r["symbol"] for r in got["callees"].collect()] == ["Core.run"]


def test_hotspots(app):
    a = q.Analysis(app)
    assert q.hotspots(a, "churn", 2).collect()[0]["path"] == "main.ts"
    top = q.hotspots(a, "coverage", 10).collect()
    assert [r["score"] for r in top] == [1.0, 1.0, 1.0, 0.0] and top[-1]["reason"] == "tested (core/c.test.ts)"
    assert q.hotspots(a, "complexity").first()["path"] == "api/a.ts"  # all three of mean 2: the first
    assert q.hotspots(a, "nonsense").first()["score"] == 0.0
    for m in q.HOTSPOTS:
        assert q.hotspots(a, m).count() >= 3


def test_file_context_and_suggestions(app):
    got = q.file_context(q.Analysis(app), "src\\api/a.ts".replace("\\", "/"))
    assert got["metrics"].first()["dead_exports"] == ["unusedA"] and [r["from"] for r in got["imports"].collect()] == ["core/c.ts"]
    with pytest.raises(q.NotFound) as e:
        q.file_context(q.Analysis(app), "api/z.ts")
    assert e.value.suggestions[0].startswith("api/")


def test_search(app):
    a = q.Analysis(app)
    got = q.search_files(a, "getA core")
    assert {r["file"] for r in got["results"].collect()} >= {"api/a.ts", "core/c.ts"}
    near = q.search_files(a, "coreful")
    assert near["results"].isEmpty() and near["suggestions"].first()["term"] == "core"


def test_changes(spark, app):
    got = q.changes(q.Analysis(app), spark.createDataFrame([("repo/core/c.ts",), ("api/b.ts",), ("x.md",)], "file string"))
    assert rows(got["affected_files"], "file") == [("api/a.ts",), ("api/b.ts",), ("core/c.test.ts",), ("main.ts",)]
    assert {r["file"] for r in got["file_risk"].collect()} == {"repo/core/c.ts", "api/b.ts"}


def test_empty_graph(spark):
    a = q.Analysis(facts(spark, []))
    assert a.files.count() == 0 and a.cycles.count() == 0 and a.clusters.count() == 0 and q.groups(a).count() == 0
    assert q.overview(a)["totals"].first()["total_files"] == 0


def test_reach_by_depth(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "source string, target string")
    assert rows(iterate.reach(e).where("origin = 'a'"), "node", "depth") == [("a", 3), ("b", 1), ("c", 2)]
    starts = spark.createDataFrame([("q", "a")], "origin string, node string")
    assert rows(iterate.reach(e, starts, 1), "node", "depth") == [("b", 1)]
    assert rows(iterate.reach(e, starts), "node", "depth") == [("b", 1), ("c", 2)]


def test_bm25_ranks_repeats_first(spark):
    t = spark.createDataFrame([("1", "alpha beta"), ("2", "alphaAlpha beta gamma"), ("3", "delta")], "file string, text string")
    assert [r["file"] for r in search.search(t, "alpha").collect()] == ["2", "1"]
    assert search.search(t, "").count() == 0
