"""The code graph: files, exports, imports and call sites joined into nodes and edges.

Facts (``ord`` columns carry the order in which a scan meets rows):
``files(path, loc, churn, is_test, test_file, ord)``,
``exports(file, name, kind, loc, is_default, complexity, ord)``,
``imports(file, resolved, symbols, is_type_only, ord)``,
``call_sites(caller_file, caller_symbol, callee_file, callee_symbol, confidence, ord)``.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import basename, module_of
from ..functions.lineage import cut

SCHEMAS = {
    "files": "path string, loc long, churn long, is_test boolean, test_file string, ord long",
    "exports": "file string, name string, kind string, loc long, is_default boolean, complexity long, ord long",
    "imports": "file string, resolved string, symbols array<string>, is_type_only boolean, ord long",
    "call_sites": "caller_file string, caller_symbol string, callee_file string, callee_symbol string, confidence string, ord long",
}


@dataclass(frozen=True)
class CodeGraph:
    """Tables of one code base. ``files`` has its module; ids are paths and ``path::name``."""

    files: DataFrame
    exports: DataFrame
    edges: DataFrame
    symbols: DataFrame
    call_edges: DataFrame

    def pinned(self) -> CodeGraph:
        """The same tables computed once, for queries that read them often."""
        return replace(self, **{k: cut(v) for k, v in vars(self).items()})

    @property
    def nodes(self) -> DataFrame:
        """id, type, path, label, loc, module, parent_file, ord of files and of their functions and classes."""
        own = self.files.select(F.col("path").alias("id"), F.lit("file").alias("type"), "path", basename(F.col("path")).alias("label"), "loc", "module", F.lit(None).cast("string").alias("parent_file"), F.struct("ord", F.lit(-1).cast("long").alias("sub")).alias("ord"))
        return own.unionByName(sub_nodes(self.files, self.exports))


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[name])


def sub_nodes(files: DataFrame, exports: DataFrame) -> DataFrame:
    """The functions and classes that files export."""
    kept = exports.where(F.col("kind").isin("function", "class")).withColumnRenamed("ord", "sub").withColumnRenamed("loc", "own_loc")
    return kept.join(files, kept["file"] == files["path"]).select(
        F.concat_ws("::", "path", "name").alias("id"), F.col("kind").alias("type"), "path", F.col("name").alias("label"), F.col("own_loc").alias("loc"), "module", F.col("path").alias("parent_file"), F.struct("ord", F.col("sub").alias("sub")).alias("ord")
    )


def import_edges(files: DataFrame, imports: DataFrame) -> DataFrame:
    """source, target, symbols, is_type_only, weight, ord: the imports between known files, one row a pair.

    Several imports of one target keep the union of their symbols in order of
    first appearance, and are type-only if all are; one import keeps its list as it is.
    """
    known = files.select(F.col("path").alias("target"))
    sources = files.select(F.col("path").alias("source"))
    met = (
        imports.select(F.col("file").alias("source"), F.col("resolved").alias("target"), "symbols", "is_type_only", "ord")
        .where("source <> target")
        .join(known, "target", "left_semi")
        .join(sources, "source", "left_semi")
    )
    listed = met.groupBy("source", "target").agg(
        F.array_sort(F.collect_list(F.struct("ord", "symbols"))).alias("all"), F.min("is_type_only").alias("is_type_only"), F.min("ord").alias("ord")
    )
    symbols = F.when(F.size("all") == 1, F.col("all")[0]["symbols"]).otherwise(F.array_distinct(F.flatten(F.col("all.symbols"))))
    return listed.select("source", "target", symbols.alias("symbols"), "is_type_only", F.greatest(F.size(symbols), F.lit(1)).cast("long").alias("weight"), "ord")


def with_test_edges(files: DataFrame, edges: DataFrame) -> DataFrame:
    """Import edges, and one of weight 1 from a test to its file where none is."""
    tests = files.where("test_file IS NOT NULL").select(F.col("test_file").alias("source"), F.col("path").alias("target"), F.col("ord").alias("o"))
    tests = tests.join(files.select(F.col("path").alias("source")), "source", "left_semi").join(edges, ["source", "target"], "left_anti")
    last = 1 << 62  # after every import of up to 2**31 files
    return edges.unionByName(tests.select("source", "target", F.array(F.lit("tests")).alias("symbols"), F.lit(False).alias("is_type_only"), F.lit(1).cast("long").alias("weight"), (F.col("o") + last).alias("ord")))


def call_graph(files: DataFrame, exports: DataFrame, call_sites: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(symbols: id, name, kind, file, loc, is_default, complexity, ord; call edges: source, target, caller_symbol, callee_symbol, confidence, ord)."""
    paths = files.select("path", F.col("ord").alias("file_ord"))
    exported = (
        exports.where("kind <> 'variable'")
        .join(paths, F.col("file") == F.col("path"))
        .select(F.concat_ws("::", "file", "name").alias("id"), "name", "kind", "file", "loc", "is_default", "complexity", F.struct(F.lit(0).alias("late"), F.col("file_ord").alias("a"), F.col("ord").alias("b")).alias("ord"))
    )
    sites = (
        call_sites.where(~F.contains("callee_file", F.lit("node_modules")) & F.col("callee_file").isNotNull())
        .join(files.select(F.col("path").alias("callee_file")), "callee_file", "left_semi")
        .select(F.concat_ws("::", "caller_file", "caller_symbol").alias("source"), F.concat_ws("::", "callee_file", "callee_symbol").alias("target"), "caller_symbol", "callee_symbol", "caller_file", "callee_file", "confidence", "ord")
    )
    ends = sites.select(F.col("source").alias("id"), F.col("caller_symbol").alias("name"), F.col("caller_file").alias("file"), "ord", F.lit(0).alias("side")).unionByName(
        sites.select(F.col("target").alias("id"), F.col("callee_symbol").alias("name"), F.col("callee_file").alias("file"), "ord", F.lit(1).alias("side"))
    )
    implicit = (
        ends.join(exported, "id", "left_anti")
        .groupBy("id", "name", "file")
        .agg(F.min(F.struct(F.lit(1).alias("late"), F.col("ord").alias("a"), F.col("side").cast("long").alias("b"))).alias("ord"))
        .select("id", "name", F.lit("function").alias("kind"), "file", F.lit(0).cast("long").alias("loc"), F.lit(False).alias("is_default"), F.lit(0).cast("long").alias("complexity"), "ord")
    )
    first = F.row_number().over(Window.partitionBy("source", "target").orderBy("ord"))
    edges = sites.withColumn("n", first).where("n = 1").select("source", "target", "caller_symbol", "callee_symbol", "confidence", "ord")
    return exported.unionByName(implicit), edges


def build_graph(files: DataFrame, exports: DataFrame, imports: DataFrame, call_sites: DataFrame) -> CodeGraph:
    files = files.withColumn("module", module_of(F.col("path")))
    symbols, call_edges = call_graph(files, exports, call_sites)
    return CodeGraph(files, exports, with_test_edges(files, import_edges(files, imports)), symbols, call_edges)
