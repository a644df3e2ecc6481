"""Metrics of files, modules and groups of modules, from the file graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import basename, cloud_group, dirname, fan_coupling, half_up, is_test_path
from ..plans.graph import CodeGraph

COLORS = 20


def degrees(nodes: DataFrame, edges: DataFrame, key: str = "path") -> DataFrame:
    """key, fan_in, fan_out, coupling of every node, counted in one pass over the edges."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("source").alias(key), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("target").alias(key), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e")).select("e.*")
    counted = ends.groupBy(key).agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))
    out = nodes.select(key).join(counted, key, "left").na.fill(0, ["fan_in", "fan_out"])
    return out.withColumn("coupling", fan_coupling(F.col("fan_in"), F.col("fan_out")))


def complexity(files: DataFrame, exports: DataFrame) -> DataFrame:
    """path, complexity: the mean over a file's exports, 1 without any."""
    mean = exports.groupBy(F.col("file").alias("path")).agg(half_up(F.avg("complexity"), 2).alias("complexity"))
    return files.select("path").join(mean, "path", "left").na.fill(1.0, ["complexity"])


def consumed_symbols(edges: DataFrame, call_edges: DataFrame) -> DataFrame:
    """file, name: what any import or call names, a method by its class."""
    imported = edges.select(F.col("target").alias("file"), F.explode("symbols").alias("name"))
    called = call_edges.select(F.substring_index("target", "::", 1).alias("file"), F.substring_index("callee_symbol", ".", 1).alias("name"))
    return imported.union(called).distinct()


def dead_exports(exports: DataFrame, consumed: DataFrame) -> DataFrame:
    """file, name, ord of the exports but defaults that nothing consumes."""
    return exports.where("NOT is_default").join(consumed, ["file", "name"], "left_anti").select("file", "name", "ord")


def unused_exports(exports: DataFrame) -> DataFrame:
    """``dead_exports`` where the exports tell whether they are ``used``; what isn't known to be unused stays out."""
    return exports.where("NOT is_default AND NOT used").select("file", "name", "ord")


def module_metrics(graph: CodeGraph) -> DataFrame:
    """path, files, loc, exports, internal_deps, external_deps, cohesion, escape_velocity, depends_on, depended_by, ord."""
    counts = graph.exports.groupBy(F.col("file").alias("path")).agg(F.count(F.lit(1)).alias("n"))
    own = graph.files.join(counts, "path", "left").groupBy("module").agg(F.count(F.lit(1)).alias("files"), F.sum("loc").alias("loc"), F.sum(F.coalesce("n", F.lit(0))).alias("exports"), F.min("ord").alias("ord"))
    pairs = module_pairs(graph)
    out = pairs.groupBy(F.col("a").alias("module")).agg(
        F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("internal_deps"),
        F.sum(F.when(F.col("a") != F.col("b"), F.col("n")).otherwise(0)).alias("external_deps"),
        F.array_sort(F.collect_set(F.when(F.col("a") != F.col("b"), F.col("b")))).alias("depends_on"),
    )
    into = pairs.where("a <> b").groupBy(F.col("b").alias("module")).agg(F.array_sort(F.collect_set("a")).alias("depended_by"))
    none = F.array().cast("array<string>")
    joined = own.join(out, "module", "left").join(into, "module", "left").na.fill(0, ["internal_deps", "external_deps"])
    joined = joined.withColumn("depends_on", F.coalesce("depends_on", none)).withColumn("depended_by", F.coalesce("depended_by", none))
    total = own.agg(F.count(F.lit(1)).alias("modules"))
    deps, users = F.col("internal_deps") + F.col("external_deps"), F.size("depended_by")
    cohesion = F.when(deps == 0, 1.0).otherwise(F.col("internal_deps") / deps)
    # modules that use this one are others, so there are two modules at least
    escape = F.when((F.col("external_deps") == 0) & (users > 0), F.least(F.lit(1.0), users / (F.col("modules") - 1))).otherwise(0.0)
    return joined.crossJoin(F.broadcast(total)).select(F.col("module").alias("path"), "files", "loc", "exports", "internal_deps", "external_deps", half_up(cohesion, 2).alias("cohesion"), half_up(escape, 2).alias("escape_velocity"), "depends_on", "depended_by", "ord")


def module_pairs(graph: CodeGraph) -> DataFrame:
    """a, b, n, ord: edges between the files of two modules (or of one)."""
    of = graph.files.select("path", "module")
    a = of.select(F.col("path").alias("source"), F.col("module").alias("a"))
    b = of.select(F.col("path").alias("target"), F.col("module").alias("b"))
    return graph.edges.join(a, "source").join(b, "target").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("ord"))


def groups(files: DataFrame, metrics: DataFrame) -> DataFrame:
    """rank, name, files, loc, importance, fan_in, fan_out, color; ``metrics`` has path, page_rank, fan_in, fan_out."""
    summed = (
        files.join(metrics.select("path", "page_rank", "fan_in", "fan_out"), "path")
        .groupBy(cloud_group(F.col("module")).alias("name"))
        .agg(F.count(F.lit(1)).alias("files"), F.sum("loc").alias("loc"), F.sum("page_rank").alias("pr"), F.sum("fan_in").alias("fan_in"), F.sum("fan_out").alias("fan_out"), F.min("ord").alias("ord"))
    )
    rank = F.row_number().over(Window.orderBy(F.desc(half_up(F.col("pr"), 9)), "ord"))  # one row a group of modules
    return summed.select(rank.alias("rank"), "name", "files", "loc", half_up(F.col("pr"), 4).alias("importance"), "fan_in", "fan_out", F.pmod(rank - 1, F.lit(COLORS)).alias("color"))


def cohesion_verdicts(files: DataFrame, modules: DataFrame, cohesive: float = 0.6, moderate: float = 0.4) -> DataFrame:
    """path, cohesion, verdict, files, ord."""
    plain = files.groupBy(F.col("module").alias("path")).agg(F.count_if(~is_test_path(F.col("path"))).alias("plain"))
    verdict = F.when(F.col("plain") <= 1, "LEAF").when(F.col("cohesion") >= cohesive, "COHESIVE").when(F.col("cohesion") >= moderate, "MODERATE").otherwise("JUNK_DRAWER")
    return modules.join(plain, "path").select("path", "cohesion", verdict.alias("verdict"), "files", "ord")


def pulls(graph: CodeGraph) -> DataFrame:
    """file, module, strength, symbols: how each foreign module pulls a file."""
    of = graph.files.select("path", "module")
    a = of.select(F.col("path").alias("source"), F.col("module").alias("a"))
    b = of.select(F.col("path").alias("target"), F.col("module").alias("b"))
    across = graph.edges.join(a, "source").join(b, "target").where("a <> b")
    none = F.array().cast("array<string>")
    both = across.select(F.explode(F.array(
        F.struct(F.col("source").alias("file"), F.col("b").alias("module"), F.greatest(F.col("weight"), F.lit(1)).cast("double").alias("strength"), F.col("symbols").alias("symbols")),
        F.struct(F.col("target").alias("file"), F.col("a").alias("module"), F.lit(0.5).alias("strength"), none.alias("symbols")),
    )).alias("p")).select("p.*")
    return both.groupBy("file", "module").agg(half_up(F.sum("strength"), 2).alias("strength"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("symbols")))).alias("symbols"))


def tension_files(graph: CodeGraph, least: float = 0.3) -> DataFrame:
    """file, tension, pulled_by, recommendation of the files that modules pull evenly."""
    base = basename(F.col("file"))
    hub = base.isin("types.ts", "constants.ts", "config.ts") | ((base == "index.ts") & (basename(dirname(F.col("file"))) == "types"))
    entry = base.isin("cli.ts", "main.ts", "app.ts", "server.ts") | ((base == "index.ts") & (dirname(F.col("file")) == "."))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("strength")).alias("k"), "module", "strength", "symbols")))
    pulled = pulls(graph).groupBy("file").agg(F.sum("strength").alias("t"), F.sum(F.col("strength") * F.ln("strength")).alias("sl"), F.count(F.lit(1)).alias("k"), ranked.alias("r")).where("k >= 2")
    # entropy of shares s/t is ln t - sum(s ln s)/t
    tension = half_up((F.ln("t") - F.col("sl") / F.col("t")) / F.ln("k"), 2)
    part = lambda i: F.concat(basename(F.regexp_replace(F.col("r")[i]["module"], "/$", "")), F.lit("-"), base)
    advice = F.when(hub, "Type hub — split not recommended (design-intentional shared types)").when(entry, "Entry point — split not recommended (CLI/app entry point)").otherwise(F.concat(F.lit("Split into "), part(0), F.lit(" and "), part(1)))
    shown = F.transform("r", lambda x: F.struct(x["module"].alias("module"), x["strength"].alias("strength"), x["symbols"].alias("symbols")))
    return pulled.select("file", tension.alias("tension"), shown.alias("pulled_by"), advice.alias("recommendation")).where(F.col("tension") > least)


def bridge_files(graph: CodeGraph, betweenness: DataFrame, least: float = 0.05) -> DataFrame:
    """file, betweenness, connects, role of central files between two other modules or more."""
    of = graph.files.select("path", "module")
    linked = graph.edges.select("source", "target").union(graph.edges.select("target", "source")).toDF("file", "other")
    own, far = of.toDF("file", "m"), of.toDF("other", "n")
    met = linked.join(betweenness.where(F.col("betweenness") >= least).select(F.col("path").alias("file"), "betweenness"), "file").join(own, "file").join(far, "other").where("m <> n")
    out = met.groupBy("file").agg(F.first("betweenness").alias("b"), F.array_sort(F.collect_set("n")).alias("connects")).where(F.size("connects") >= 2)
    return out.select("file", half_up(F.col("b"), 2).alias("betweenness"), "connects", F.concat(F.lit("Bridge between "), F.size("connects"), F.lit(" otherwise-disconnected modules")).alias("role"))


def extraction_candidates(modules: DataFrame, least: float = 0.5) -> DataFrame:
    left = F.when(F.col("external_deps") == 0, "0 deps on host codebase").otherwise(F.concat(F.col("external_deps"), F.lit(" deps to resolve")))
    return modules.where(F.col("escape_velocity") >= least).select(F.col("path").alias("target"), "escape_velocity", "internal_deps", "external_deps", F.size("depended_by").alias("depended_by_modules"), F.concat(F.lit("Extract to standalone package — "), left).alias("recommendation"))


def force_summary(verdicts: DataFrame, tension: DataFrame, extraction: DataFrame) -> DataFrame:
    """One row: what is out of balance, in words."""
    junk = verdicts.where("verdict = 'JUNK_DRAWER'").agg(F.count(F.lit(1)).alias("nj"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "path"))), lambda x: x["path"]), ", ").alias("pj"))
    tense = tension.agg(F.count(F.lit(1)).alias("nt"))
    ready = extraction.agg(F.array_join(F.array_sort(F.collect_list("target")), ", ").alias("pe"))
    parts = F.concat_ws(
        ". ",
        F.when(F.col("nj") > 0, F.concat(F.col("nj"), F.lit(" junk-drawer module(s) ("), F.col("pj"), F.lit(")"))),
        F.when(F.col("nt") > 0, F.concat(F.col("nt"), F.lit(" tension file(s) need splitting"))),
        F.when(F.col("pe") != "", F.concat(F.col("pe"), F.lit(" ready for extraction"))),
    )
    return junk.crossJoin(tense).crossJoin(ready).select(F.concat(F.when(parts == "", "Codebase architecture looks healthy. No major force imbalances detected.").otherwise(parts), F.lit(".")).alias("summary"))


def stats(graph: CodeGraph) -> DataFrame:
    """total_files, total_functions, total_dependencies."""
    f = graph.files.agg(F.count(F.lit(1)).alias("total_files"))
    s = graph.exports.agg(F.count_if(F.col("kind").isin("function", "class")).alias("total_functions"))
    return f.crossJoin(s).crossJoin(graph.edges.agg(F.count(F.lit(1)).alias("total_dependencies")))
