"""Operators over the call graph: entry points, processes, impact, references."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import basename
from .iterate import betweenness, pagerank, reach, reversed_edges
from .metrics import degrees

DEEPEST = 21


def symbol_metrics(symbols: DataFrame, call_edges: DataFrame, **rank) -> DataFrame:
    """id, name, file, fan_in, fan_out, page_rank, betweenness of every symbol."""
    ids = symbols.select("id")
    counted = degrees(ids, call_edges, "id").drop("coupling")
    return symbols.select("id", "name", "file").join(counted, "id").join(pagerank(ids, call_edges, None, **rank), "id").join(betweenness(ids, call_edges), "id")


def entry_points(symbols: DataFrame, call_edges: DataFrame) -> DataFrame:
    """The functions and classes that nothing calls."""
    return symbols.where(F.col("kind").isin("function", "class")).join(call_edges.select(F.col("target").alias("id")), "id", "left_anti")


def process_steps(symbols: DataFrame, call_edges: DataFrame) -> DataFrame:
    """entry_id, step, id, file, symbol: what each entry point reaches, and itself at step 0."""
    starts = entry_points(symbols, call_edges).select(F.col("id").alias("origin"), F.col("id").alias("node"))
    found = reach(call_edges, starts).unionByName(starts.withColumn("depth", F.lit(0)))
    known = symbols.select(F.col("id").alias("node"), "file", F.col("name").alias("symbol"))
    file = F.coalesce("file", F.substring_index("node", "::", 1))
    symbol = F.coalesce("symbol", F.expr("split(node, '::')[1]"), "node")
    return found.join(known, "node", "left").select(F.col("origin").alias("entry_id"), F.col("depth").alias("step"), F.col("node").alias("id"), file.alias("file"), symbol.alias("symbol"))


def processes(symbols: DataFrame, call_edges: DataFrame) -> DataFrame:
    """entry_id, name, file, depth, steps, modules_touched, ord of each entry point, deepest first by (depth, ord)."""
    steps = process_steps(symbols, call_edges)
    parts = F.split("file", "/")
    folder = F.when(F.size(parts) >= 2, F.element_at(parts, -2)).otherwise(parts[0])
    walked = steps.withColumn("folder", folder).groupBy("entry_id").agg(
        F.max("step").alias("depth"), F.array_sort(F.collect_list(F.struct("step", "file", "symbol"))).alias("steps"), F.array_sort(F.collect_set("folder")).alias("modules_touched")
    )
    own = symbols.select(F.col("id").alias("entry_id"), "name", "file", "ord")
    return walked.join(own, "entry_id").select("entry_id", "name", "file", "depth", "steps", "modules_touched", "ord")


def impact_targets(symbols: DataFrame, call_edges: DataFrame, query: str) -> DataFrame:
    """id of the symbols that a query names: by id, name, ``stem::name`` or ``Stem.name``, else by callee."""
    stem = F.regexp_replace(basename(F.col("file")), r"\.ts", "")
    classy = F.concat(F.upper(F.substring(stem, 1, 1)), F.expr(f"substring({_sql_stem()}, 2)"), F.lit("."), F.col("name"))
    named = symbols.where((F.col("id") == query) | (F.col("name") == query) | (F.concat(stem, F.lit("::"), "name") == query) | (classy == query)).select("id").distinct()
    if not named.isEmpty():
        return named
    return call_edges.where((F.col("callee_symbol") == query) | F.endswith("target", F.lit(f"::{query}"))).select(F.col("target").alias("id")).distinct()


def _sql_stem() -> str:
    return r"regexp_replace(element_at(split(file, '/'), -1), '\\.ts', '')"


def impact(symbols: DataFrame, call_edges: DataFrame, query: str) -> DataFrame:
    """depth, risk, file, symbol, confidence of the callers, direct and indirect, of what a query names."""
    targets = impact_targets(symbols, call_edges, query)
    found = reach(reversed_edges(call_edges), targets.select(F.lit(query).alias("origin"), F.col("id").alias("node")), DEEPEST)
    risk = F.when(F.col("depth") == 1, "WILL BREAK").when(F.col("depth") == 2, "LIKELY").otherwise("MAY NEED TESTING")
    # a caller's confidence is that of its first call into the level before
    level = found.select(F.col("node").alias("target"), (F.col("depth") + 1).alias("depth")).unionByName(targets.select(F.col("id").alias("target"), F.lit(1).alias("depth")))
    sure = call_edges.join(level, "target").groupBy(F.col("source").alias("node"), "depth").agg(F.min_by("confidence", "ord").alias("confidence"))
    known = symbols.select(F.col("id").alias("node"), "file", "name")
    return found.join(sure, ["node", "depth"]).join(known, "node", "left").select("depth", risk.alias("risk"), F.coalesce("file", F.substring_index("node", "::", 1)).alias("file"), F.coalesce("name", F.expr("split(node, '::')[1]"), "node").alias("symbol"), "confidence")


def references(symbols: DataFrame, call_edges: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """file, symbol, confidence: where a symbol is defined, called and imported, once a file after its definitions."""
    defined = symbols.where(F.col("name") == name).select("file", F.lit(name).alias("symbol"), F.lit("type-resolved").alias("confidence"))
    of = symbols.select(F.col("id").alias("source"), "file")
    called = call_edges.where(F.col("callee_symbol") == name).join(of, "source", "left").select(F.coalesce("file", F.substring_index("source", "::", 1)).alias("file"), "confidence", "ord")
    first = F.row_number().over(Window.partitionBy("file").orderBy("ord"))
    called = called.join(defined, "file", "left_anti").withColumn("n", first).where("n = 1").select("file", F.lit(name).alias("symbol"), "confidence")
    met = defined.unionByName(called)
    imported = edges.where(F.array_contains("symbols", name)).select(F.col("source").alias("file")).distinct().join(met, "file", "left_anti")
    return met.unionByName(imported.select("file", F.lit(name).alias("symbol"), F.lit("text-inferred").alias("confidence")))
