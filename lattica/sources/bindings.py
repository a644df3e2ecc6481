"""Star-schema tables as facts of a code base, so that every operator has data at scale.

=========  ==============================================================
trade      nations as files, regions as modules, an edge to each nation that a
           nation's customers buy from
parts      parts as files of brand/type modules; a returned line imports the
           line before it in its order, by supplier
supply     suppliers as files, shipped parts as exports, returned ones consumed
flows      a user's event types as symbols, events within an hour as calls
corpus     documents as texts
=========  ==============================================================
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.graph import CodeGraph, build_graph, empty


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trade(spark: SparkSession, sf_dir: str, most: int | None = None) -> CodeGraph:
    """``most``: main partners of each nation, None for all that there are."""
    t = lambda name: table(spark, sf_dir, name)
    nation = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    people = t("customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("loc"))
    files = nation.join(people, "n_nationkey", "left").select(
        F.concat_ws("/", "r_name", "n_name").alias("path"), F.coalesce("loc", F.lit(0)).alias("loc"), F.lit(0).cast("long").alias("churn"), F.lit(False).alias("is_test"),
        F.lit(None).cast("string").alias("test_file"), F.col("n_nationkey").cast("long").alias("ord"), F.concat("r_name", F.lit("/")).alias("module"),
    )
    # lines meet suppliers and shrink to one row per order and nation before customers join
    lines = t("lineitem").select("l_orderkey", "l_suppkey").join(t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("long").alias("b")), "l_suppkey")
    buyers = t("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey")).join(t("customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("a")), "c_custkey")
    pairs = lines.join(buyers, "l_orderkey").where("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("weight"))
    best = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("weight"), "b"))
    top = pairs if most is None else pairs.withColumn("n", best).where(F.col("n") <= most)
    of = files.select("path", "ord")
    edges = top.join(of.toDF("source", "a"), "a").join(of.toDF("target", "b"), "b").select("source", "target", F.array().cast("array<string>").alias("symbols"), F.lit(False).alias("is_type_only"), "weight", (F.col("a") * 1000 + F.col("b")).alias("ord"))
    none = build_graph(empty(spark, "files"), empty(spark, "exports"), empty(spark, "imports"), empty(spark, "call_sites"))
    return CodeGraph(files, empty(spark, "exports"), edges, none.symbols, none.call_edges)


def parts(spark: SparkSession, sf_dir: str) -> CodeGraph:
    lines = table(spark, sf_dir, "lineitem")
    churn = lines.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("churn"))
    named = table(spark, sf_dir, "part").withColumn("path", F.concat("p_brand", F.lit("/"), "p_type", F.lit("/part_"), "p_partkey", F.when(F.col("p_size") == 1, ".spec").otherwise("")))
    files = named.join(churn, "p_partkey", "left").select("path", F.col("p_size").cast("long").alias("loc"), F.coalesce("churn", F.lit(0)).alias("churn"), (F.col("p_size") == 1).alias("is_test"), F.lit(None).cast("string").alias("test_file"), F.col("p_partkey").alias("ord"))
    exports = named.select(F.col("path").alias("file"), F.concat(F.lit("part_"), "p_partkey").alias("name"), F.lit("function").alias("kind"), F.col("p_size").cast("long").alias("loc"), F.lit(False).alias("is_default"), (1 + F.col("p_size") % 5).cast("long").alias("complexity"), F.lit(0).cast("long").alias("ord"))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    before = lines.where("l_returnflag = 'R'").select("l_orderkey", "l_partkey", F.lag("l_partkey").over(order).alias("p"), F.lag("l_suppkey").over(order).alias("s"), (F.col("l_orderkey") * 1000 + F.row_number().over(order)).alias("ord")).where("p IS NOT NULL")
    of = named.select("p_partkey", "path")
    imports = before.join(of.toDF("l_partkey", "file"), "l_partkey").join(of.toDF("p", "resolved"), "p").select("file", "resolved", F.array(F.col("s").cast("string")).alias("symbols"), F.lit(False).alias("is_type_only"), "ord")
    return build_graph(files, exports, imports, empty(spark, "call_sites"))


def supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, name, is_default, used, ord of the exports; a line tells of its own export whether it is consumed."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.max(F.col("l_returnflag") == "R").alias("used"))
    return lines.select(F.concat(F.lit("supplier_"), "l_suppkey").alias("file"), F.concat(F.lit("part_"), "l_partkey").alias("name"), F.lit(False).alias("is_default"), "used", F.col("l_partkey").alias("ord"))


def flows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(symbols, call edges) of users' event types."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    file = F.concat(F.lit("users/user_"), "user_id")
    symbols = events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("loc")).select(
        F.concat(file, F.lit("::"), "event_type").alias("id"), F.col("event_type").alias("name"), F.lit("function").alias("kind"), file.alias("file"), "loc",
        F.lit(False).alias("is_default"), F.lit(0).cast("long").alias("complexity"), F.struct("user_id", "event_type").alias("ord"),
    )
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    met = events.select("user_id", "event_type", "ts", "event_id", F.lag("event_type").over(order).alias("was"), F.lag("ts").over(order).alias("then"))
    calls = met.where((F.col("was") != F.col("event_type")) & (F.col("ts") <= F.col("then") + F.expr("INTERVAL 1 HOUR"))).groupBy("user_id", "was", "event_type").agg(F.min("event_id").alias("ord"))
    edges = calls.select(
        F.concat(file, F.lit("::"), "was").alias("source"), F.concat(file, F.lit("::"), "event_type").alias("target"), F.col("was").alias("caller_symbol"), F.col("event_type").alias("callee_symbol"), F.lit("type-resolved").alias("confidence"), "ord",
    )
    return symbols, edges


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, text."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file"), F.coalesce("text", F.lit("")).alias("text"))
