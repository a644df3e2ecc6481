"""The fifteen queries over a code graph. Each returns a DataFrame, or a dict of them where a result has parts."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import half_up, normalized_path
from ..operators import calls, cycles, iterate, metrics, search
from .graph import CodeGraph, sub_nodes

HOTSPOTS = ("coupling", "pagerank", "fan_in", "fan_out", "betweenness", "tension", "escape_velocity", "churn", "complexity", "blast_radius", "coverage")


class NotFound(LookupError):
    """What was asked for isn't in the graph; ``suggestions`` names what is near."""

    def __init__(self, message: str, suggestions: list[str] | None = None) -> None:
        super().__init__(message)
        self.suggestions = suggestions or []


@dataclass(frozen=True)
class Analysis:
    """A code graph with its metrics, each computed when first asked for."""

    graph: CodeGraph
    rank_tolerance: float = 1e-6
    rank_rounds: int = 100

    @cached_property
    def _ids(self) -> DataFrame:
        return self.graph.files.select(F.col("path").alias("id"))

    @cached_property
    def page_rank(self) -> DataFrame:
        return iterate.pagerank(self._ids, self.graph.edges, iterations=self.rank_rounds, tolerance=self.rank_tolerance).withColumnRenamed("id", "path")

    @cached_property
    def betweenness(self) -> DataFrame:
        return iterate.betweenness(self._ids, self.graph.edges).withColumnRenamed("id", "path")

    @cached_property
    def blast_radius(self) -> DataFrame:
        return iterate.blast_radius(self.graph.files, self.graph.edges)

    @cached_property
    def modules(self) -> DataFrame:
        return metrics.module_metrics(self.graph)

    @cached_property
    def tension(self) -> DataFrame:
        return metrics.tension_files(self.graph)

    @cached_property
    def dead(self) -> DataFrame:
        return metrics.dead_exports(self.graph.exports, metrics.consumed_symbols(self.graph.edges, self.graph.call_edges))

    @cached_property
    def cycles(self) -> DataFrame:
        return cycles.circular_dependencies(self.graph.files, self.graph.edges)

    @cached_property
    def clusters(self) -> DataFrame:
        return cycles.clusters(self.graph.files, self.graph.edges)

    @cached_property
    def processes(self) -> DataFrame:
        return calls.processes(self.graph.symbols, self.graph.call_edges)

    @cached_property
    def symbols(self) -> DataFrame:
        return calls.symbol_metrics(self.graph.symbols, self.graph.call_edges, iterations=self.rank_rounds, tolerance=self.rank_tolerance)

    @cached_property
    def files(self) -> DataFrame:
        """All metrics of a file, one row each."""
        g = self.graph
        dead = self.dead.groupBy(F.col("file").alias("path")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"]).alias("dead_exports"))
        out = metrics.degrees(g.files, g.edges)
        for part in (self.page_rank, self.betweenness, self.blast_radius, metrics.complexity(g.files, g.exports)):
            out = out.join(part, "path")
        out = out.join(self.tension.select(F.col("file").alias("path"), "tension"), "path", "left").join(dead, "path", "left").join(g.files, "path")
        return out.select(
            "path", "module", "ord", "loc", "fan_in", "fan_out", "coupling", "page_rank", "betweenness", "blast_radius", "complexity", "churn",
            F.coalesce("tension", F.lit(0.0)).alias("tension"), (F.col("betweenness") > 0.1).alias("is_bridge"),
            F.coalesce("dead_exports", F.array().cast("array<string>")).alias("dead_exports"),
            F.col("test_file").isNotNull().alias("has_tests"), F.coalesce("test_file", F.lit("")).alias("test_file"), F.col("is_test").alias("is_test_file"),
        )


def overview(a: Analysis) -> dict[str, DataFrame]:
    """totals, modules by files, the five files of most dependents."""
    g = a.graph
    shape = g.files.agg(half_up(F.avg("loc")).cast("long").alias("avg_loc"), F.max(F.size(F.split("path", "/"))).alias("max_depth"))
    label = F.when(F.col("cohesion") < 0.4, "HIGH").when(F.col("cohesion") < 0.7, "MEDIUM").otherwise("LOW")
    top = metrics.degrees(g.files, g.edges).join(g.files.select("path", "ord"), "path").orderBy(F.desc("fan_in"), "ord").limit(5)
    return {
        "totals": metrics.stats(g).crossJoin(shape).crossJoin(a.cycles.agg(F.count(F.lit(1)).alias("circular_deps"))),
        "modules": a.modules.select("path", "files", "loc", label.alias("avg_coupling"), "cohesion", "ord").orderBy(F.desc("files"), "ord").drop("ord"),
        "top_depended": top.select("path", "fan_in"),
    }


def suggest_paths(files: DataFrame, query: str, most: int = 3) -> DataFrame:
    """path, score of the paths most like a query, else the first ones."""
    q = query.lower()
    base = q.split("/")[-1]
    low = F.lower("path")
    same = F.lit(0)
    for k in range(len(q), 0, -1):
        same = F.when((same == 0) & F.startswith(low, F.lit(q[:k])), k).otherwise(same)
    score = F.when(F.contains(low, F.lit(q)), 10.0).otherwise(0.0) + F.when(F.element_at(F.split(low, "/"), -1) == base, 5.0).otherwise(0.0) + F.when(F.contains(low, F.lit(base)), 3.0).otherwise(0.0) + same * 0.1
    return files.select("path", score.alias("score"), "ord").orderBy(F.desc("score"), "ord").limit(most).select("path", "score")


def _resolve(a: Analysis, raw: str) -> str:
    path = a.graph.files.limit(1).sparkSession.range(1).select(normalized_path(F.lit(raw))).first()[0]
    if a.graph.files.where(F.col("path") == path).isEmpty():
        raise NotFound(f"File not found in graph: {path}", [r["path"] for r in suggest_paths(a.graph.files, path).collect()])
    return path


def file_context(a: Analysis, path: str) -> dict[str, DataFrame]:
    """metrics, exports, imports and dependents of one file."""
    g, path = a.graph, _resolve(a, path)
    m = a.files.where(F.col("path") == path)
    return {
        "metrics": m.select("path", "loc", half_up(F.col("page_rank"), 3).alias("page_rank"), half_up(F.col("betweenness"), 2).alias("betweenness"), "fan_in", "fan_out", half_up(F.col("coupling"), 2).alias("coupling"), "tension", "is_bridge", "churn", "complexity", "blast_radius", "dead_exports", "has_tests", "test_file"),
        "exports": sub_nodes(g.files.where(F.col("path") == path), g.exports).orderBy("ord").select(F.col("label").alias("name"), "type", "loc"),
        "imports": g.edges.where(F.col("source") == path).orderBy("ord").select(F.col("target").alias("from"), "symbols", "is_type_only", "weight"),
        "dependents": g.edges.where(F.col("target") == path).orderBy("ord").select(F.col("source").alias("path"), "symbols", "is_type_only", "weight"),
    }


def dependents(a: Analysis, path: str, depth: int = 2) -> dict[str, DataFrame]:
    """summary (total_affected, risk_level), direct, transitive (path, through, depth) dependents of a file."""
    g = a.graph
    if g.files.where(F.col("path") == path).isEmpty():
        raise NotFound(f"File not found in graph: {path}")
    back = g.edges.select(F.col("target").alias("at"), F.col("source").alias("path"), F.col("ord").alias("e"))
    level = g.files.where(F.col("path") == path).select("path", F.array().cast("array<string>").alias("through"), F.array(F.lit(0).cast("long")).alias("turn"))
    seen, found = level.select("path"), []
    for d in range(1, depth + 1):
        # of the ways into a file at this depth, the one met first in a breadth-first walk
        ways = level.withColumnRenamed("path", "at").join(back, "at").join(seen, "path", "left_anti")
        ways = ways.select("path", F.concat("through", F.array("at")).alias("through"), F.concat("turn", F.array("e")).alias("turn"))
        level = iterate.cut(ways.groupBy("path").agg(F.min_by("through", "turn").alias("through"), F.min("turn").alias("turn")))
        if level.isEmpty():
            break
        found.append(level.withColumn("depth", F.lit(d)))
        seen = seen.union(level.select("path"))
    none = level.limit(0).withColumn("depth", F.lit(0))
    every = none
    for f in found:
        every = every.unionByName(f)
    total = F.count(F.lit(1))
    return {
        "summary": every.agg(total.alias("total_affected")).select(F.lit(path).alias("file"), "total_affected", F.when(F.col("total_affected") > 20, "HIGH").when(F.col("total_affected") > 5, "MEDIUM").otherwise("LOW").alias("risk_level")),
        "direct": g.edges.where(F.col("target") == path).orderBy("ord").select(F.col("source").alias("path"), "symbols"),
        "transitive": every.where("depth > 1").orderBy("depth", "turn").select("path", "through", "depth"),
    }


def hotspots(a: Analysis, metric: str, limit: int = 10) -> DataFrame:
    """rank, path, score, reason of the highest scores; ties keep the files' order."""
    text = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    g = a.graph
    c = F.col
    if metric == "escape_velocity":
        rows = a.modules.select("path", c("escape_velocity").alias("score"), text(F.size("depended_by"), " modules depend on it, ", c("external_deps"), " external deps").alias("reason"), "ord")
    else:
        # each metric computes what it needs and no more
        base = g.files
        plan = {
            "coupling": lambda: (base.where("NOT is_test").join(metrics.degrees(base, g.edges), "path"), c("coupling"), text("fan-in: ", c("fan_in"), ", fan-out: ", c("fan_out"))),
            "pagerank": lambda: (base.join(metrics.degrees(base, g.edges), "path").join(a.page_rank, "path"), c("page_rank"), text(c("fan_in"), " dependents")),
            "fan_in": lambda: (base.join(metrics.degrees(base, g.edges), "path"), c("fan_in"), text(c("fan_in"), " files import this")),
            "fan_out": lambda: (base.join(metrics.degrees(base, g.edges), "path"), c("fan_out"), text("imports ", c("fan_out"), " files")),
            "betweenness": lambda: (base.join(a.betweenness, "path"), c("betweenness"), F.when(c("betweenness") > 0.1, "bridge between clusters").otherwise("on many shortest paths")),
            "tension": lambda: (base.join(a.tension.select(c("file").alias("path"), "tension"), "path", "left").na.fill(0.0, ["tension"]), c("tension"), F.when(c("tension") > 0, "pulled by multiple modules").otherwise("no tension")),
            "churn": lambda: (base, c("churn"), text(c("churn"), " commits touching this file")),
            "complexity": lambda: (base.join(metrics.complexity(base, g.exports), "path"), c("complexity"), text("avg cyclomatic complexity: ", F.format_string("%.1f", c("complexity")))),
            "blast_radius": lambda: (base.join(a.blast_radius, "path"), c("blast_radius"), text(c("blast_radius"), " transitive dependents affected if changed")),
            "coverage": lambda: (base.where("NOT is_test"), F.when(c("test_file").isNull(), 1).otherwise(0), F.when(c("test_file").isNull(), "no test file found").otherwise(text("tested (", c("test_file"), ")"))),
        }
        if metric in plan:
            df, score, reason = plan[metric]()
        else:
            df, score, reason = base, F.lit(0), F.lit("")
        rows = df.select("path", score.cast("double").alias("score"), reason.alias("reason"), "ord")
    top = rows.orderBy(F.desc("score"), "ord").limit(limit)
    return top.select(F.row_number().over(Window.orderBy(F.desc("score"), "ord")).alias("rank"), "path", "score", "reason")


def hotspot_summary(top: DataFrame, metric: str) -> DataFrame:
    """One row: the first hotspot in words."""
    one = top.where("rank = 1").select(F.format_string(f"Top {metric} hotspot: %s (%.2f). %s.", "path", "score", "reason").alias("s"))
    return one.agg(F.coalesce(F.max("s"), F.lit(f"No significant {metric} hotspots found.")).alias("summary"))


def module_structure(a: Analysis) -> dict[str, DataFrame]:
    """modules, cross_module_deps (edges between two modules), circular_deps."""
    pairs = metrics.module_pairs(a.graph).where("a <> b").orderBy(F.desc("n"), "ord")
    return {"modules": a.modules.orderBy(F.desc("files"), "ord").drop("ord"), "cross_module_deps": pairs.select(F.col("a").alias("from"), F.col("b").alias("to"), F.col("n").alias("weight")), "circular_deps": a.cycles}


def forces(a: Analysis, cohesion: float = 0.6, tension: float = 0.3, escape: float = 0.5) -> dict[str, DataFrame]:
    """Module verdicts, tension and bridge files, extraction candidates and a summary.

    Thresholds filter lists that are kept at 0.3 and 0.5, and never the summary.
    """
    stored = metrics.cohesion_verdicts(a.graph.files, a.modules)
    ready = metrics.extraction_candidates(a.modules)
    return {
        "module_cohesion": metrics.cohesion_verdicts(a.graph.files, a.modules, cohesion, cohesion * 0.67).orderBy("ord").drop("ord"),
        "tension_files": a.tension.where(F.col("tension") > tension).orderBy(F.desc("tension"), "file"),
        "bridge_files": metrics.bridge_files(a.graph, a.betweenness).orderBy(F.desc("betweenness"), "file"),
        "extraction_candidates": ready.where(F.col("escape_velocity") >= escape).select("target", "escape_velocity", "recommendation").orderBy(F.desc("escape_velocity"), "target"),
        "summary": metrics.force_summary(stored, a.tension, ready),
    }


def dead_exports(a: Analysis, module: str | None = None, limit: int = 20) -> dict[str, DataFrame]:
    """files (path, module, dead_exports, total_exports) of most dead exports, and their total over all files."""
    g = a.graph
    files = g.files if module is None else g.files.where(F.col("module") == module)
    dead = a.dead.groupBy(F.col("file").alias("path")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"]).alias("dead_exports"))
    own = g.exports.where(F.col("kind").isin("function", "class")).groupBy(F.col("file").alias("path")).agg(F.count(F.lit(1)).alias("total_exports"))
    rows = files.join(dead, "path").join(own, "path", "left").na.fill(0, ["total_exports"])
    top = rows.orderBy(F.size("dead_exports").desc(), "ord").limit(limit)
    total = rows.agg(F.coalesce(F.sum(F.size("dead_exports")), F.lit(0)).alias("total_dead_exports"), F.least(F.count(F.lit(1)), F.lit(limit)).alias("shown"))
    text = F.concat("total_dead_exports", F.lit(" unused exports across "), "shown", F.lit(" files. Consider removing to reduce API surface."))
    summary = total.select(F.when(F.col("total_dead_exports") > 0, text).otherwise("No dead exports found.").alias("summary"))
    return {"total": total.drop("shown"), "summary": summary, "files": top.select("path", "module", "dead_exports", "total_exports")}


def groups(a: Analysis) -> DataFrame:
    """rank, name, files, loc, importance (a percentage), coupling, fan_in, fan_out."""
    m = metrics.degrees(a.graph.files, a.graph.edges).join(a.page_rank, "path")
    g = metrics.groups(a.graph.files, m)
    return g.select("rank", F.upper("name").alias("name"), "files", "loc", F.format_string("%.1f%%", F.col("importance") * 100).alias("importance"), (F.col("fan_in") + F.col("fan_out")).alias("coupling"), "fan_in", "fan_out")


def symbol_context(a: Analysis, name: str) -> dict[str, DataFrame]:
    """symbol (the first of that name), and the callers and callees of all symbols of that name."""
    g = a.graph
    match = g.symbols.where((F.col("name") == name) | F.endswith("id", F.lit(f"::{name}"))).orderBy("ord").limit(1)
    first = match.first()
    if first is None:
        raise NotFound(f"Symbol not found: {name}")
    m = a.symbols.where(F.col("id") == first["id"]).select("id", "fan_in", "fan_out", half_up(F.col("page_rank"), 4).alias("page_rank"), half_up(F.col("betweenness"), 4).alias("betweenness"))
    e = g.call_edges
    return {
        "symbol": match.join(m, "id").select("name", "file", F.col("kind").alias("type"), "loc", "is_default", "complexity", "fan_in", "fan_out", "page_rank", "betweenness"),
        "callers": e.where((F.col("callee_symbol") == name) | (F.col("target") == first["id"])).orderBy("ord").select(F.col("caller_symbol").alias("symbol"), F.substring_index("source", "::", 1).alias("file"), "confidence"),
        "callees": e.where((F.col("caller_symbol") == name) | (F.col("source") == first["id"])).orderBy("ord").select(F.col("callee_symbol").alias("symbol"), F.substring_index("target", "::", 1).alias("file"), "confidence"),
    }


def search_documents(g: CodeGraph) -> tuple[DataFrame, DataFrame]:
    """(file, text: path, file name and names of symbols; file, name, kind, loc of those symbols)."""
    exported = sub_nodes(g.files, g.exports).select(F.col("path").alias("file"), F.col("label").alias("name"), F.col("type").alias("kind"), "loc")
    called = g.symbols.join(exported.select("file", "name"), ["file", "name"], "left_anti").dropDuplicates(["file", "name"]).select("file", "name", "kind", "loc")
    symbols = exported.unionByName(called).join(g.files.select(F.col("path").alias("file")), "file", "left_semi")
    names = symbols.groupBy("file").agg(F.array_join(F.collect_list("name"), " ").alias("names"))
    files = g.files.select(F.col("path").alias("file"), F.element_at(F.split("path", "/"), -1).alias("label"))
    return files.join(names, "file", "left").select("file", F.concat_ws(" ", "file", "label", "names").alias("text")), symbols


def search_files(a: Analysis, query: str, limit: int = 20) -> dict[str, DataFrame]:
    """results and their symbols, or suggestions of terms where nothing matches."""
    texts, symbols = search_documents(a.graph)
    found = search.search(texts, query, limit)
    if found.isEmpty():
        return {"results": found, "suggestions": search.suggestions(search.postings(texts), query)}
    return {"results": found, "symbols": search.symbol_relevance(symbols.join(found.select("file"), "file", "left_semi"), query)}


def changes(a: Analysis, changed: DataFrame) -> dict[str, DataFrame]:
    """symbols, affected files and risk of the paths in ``changed`` (file): by equal path, else by the known paths it ends with."""
    g = a.graph
    listed = changed.select("file").distinct()

    def meet(known: DataFrame, key: str) -> DataFrame:
        same = listed.join(known, F.col("file") == F.col(key))
        rest = listed.join(known.select(F.col(key).alias("file")), "file", "left_anti")
        near = rest.join(g.files.select(F.col("path").alias("tail")), F.endswith("file", "tail")).join(known, F.col("tail") == F.col(key)).drop("tail")
        return same.unionByName(near)

    symbols = meet(g.symbols.select(F.col("file").alias("k"), "name", "ord"), "k").groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"]).alias("symbols"))
    affected = meet(g.edges.select(F.col("target").alias("k"), "source"), "k").select(F.col("source").alias("file")).distinct()
    risk = a.blast_radius.join(metrics.complexity(g.files, g.exports), "path").join(g.files.select("path", "churn", "ord"), "path").withColumnRenamed("path", "k")
    first = F.row_number().over(Window.partitionBy("file").orderBy("ord"))
    risks = meet(risk, "k").withColumn("n", first).where("n = 1").select("file", "blast_radius", "complexity", "churn")
    return {"changed_symbols": symbols, "affected_files": affected, "file_risk": risks}


def impact(a: Analysis, symbol: str) -> DataFrame:
    if calls.impact_targets(a.graph.symbols, a.graph.call_edges, symbol).isEmpty():
        raise NotFound(f"Symbol not found: {symbol}")
    return calls.impact(a.graph.symbols, a.graph.call_edges, symbol).orderBy("depth", "file", "symbol")


def rename(a: Analysis, old: str, new: str, dry_run: bool = True) -> DataFrame:
    """file, symbol, confidence of the references to change; nothing is written, whatever ``dry_run``."""
    rows = calls.references(a.graph.symbols, a.graph.call_edges, a.graph.edges, old)
    return rows.select("file", "symbol", F.lit(new).alias("new_name"), "confidence")


def processes(a: Analysis, entry: str | None = None, limit: int | None = None) -> DataFrame:
    """Processes, deepest first, by exact symbol or part of the name."""
    rows = a.processes
    if entry:
        rows = rows.where((F.col("name") == entry) | F.contains(F.lower("name"), F.lit(entry.lower())))
    rows = rows.orderBy(F.desc("depth"), "ord").drop("ord")
    return rows.limit(limit) if limit else rows


def clusters(a: Analysis, min_files: int | None = None) -> DataFrame:
    rows = a.clusters if not min_files else a.clusters.where(F.col("file_count") >= min_files)
    return rows.orderBy(F.desc("file_count"), "cluster_id")
