"""Keyword search by BM25 over documents of name tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import half_up, name_tokens

K1, B = 1.5, 0.75
#: Suggestions score above this share of overlap.
CLOSE = 0.3


def postings(texts: DataFrame) -> DataFrame:
    """file, term, tf, dl: term counts of the documents ``texts`` (file, text), several rows a file or one."""
    words = texts.select("file", F.explode(name_tokens(F.col("text"))).alias("term"))
    counted = words.groupBy("file", "term").agg(F.count(F.lit(1)).alias("tf"))
    length = words.groupBy("file").agg(F.count(F.lit(1)).alias("dl"))
    return counted.join(length, "file")


def query_terms(spark: SparkSession, query: str) -> DataFrame:
    """term, times; a term that a query repeats counts again."""
    return spark.createDataFrame([(query,)], "q string").select(F.explode(name_tokens(F.col("q"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("times"))


def search(texts: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """file, score of the best documents; score ties go by file. ``texts``: file, text.

    The query's few terms meet the texts' tokens, so only matching documents are
    counted; lengths and their mean take a pass without a shuffle of words.
    """
    terms = query_terms(texts.sparkSession, query)
    docs = texts.select("file", name_tokens(F.col("text")).alias("toks")).groupBy("file").agg(F.flatten(F.collect_list("toks")).alias("toks")) if not texts.columns == ["file", "text"] else texts.select("file", name_tokens(F.col("text")).alias("toks"))
    wanted = [r["term"] for r in terms.select("term").collect()]  # the words of one query
    hits = docs.select("file", F.size("toks").alias("dl"), F.filter("toks", lambda t: t.isin(wanted)).alias("hit")) if wanted else docs.select("file", F.size("toks").alias("dl"), F.array().cast("array<string>").alias("hit"))
    every = hits.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avg_dl"))
    found = hits.where(F.size("hit") > 0).select("file", "dl", F.explode("hit").alias("term")).groupBy("file", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    rated = df.crossJoin(F.broadcast(every)).join(terms, "term").select("term", "avg_dl", (idf * F.col("times")).alias("idf"))
    part = F.col("idf") * (F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avg_dl"))))
    scored = found.join(F.broadcast(rated), "term").groupBy("file").agg(F.sum(part).alias("s")).where("s > 0")
    return scored.select("file", half_up(F.col("s"), 3).alias("score")).orderBy(F.desc("score"), "file").limit(limit)


def symbol_relevance(symbols: DataFrame, query: str) -> DataFrame:
    """file, name, kind, loc, relevance: by how many of the query's terms a symbol's name holds; all of a file's
    symbols at 0 if none holds any. ``symbols``: file, name, kind, loc."""
    terms = F.array(*[F.lit(r["term"]) for r in query_terms(symbols.sparkSession, query).collect()])
    own = symbols.select("file", "name", "kind", "loc", name_tokens(F.col("name")).alias("toks"))
    own = own.withColumn("relevance", F.size(F.filter(terms, lambda t: F.array_contains(F.col("toks"), t)))).drop("toks")
    best = own.groupBy("file").agg(F.max("relevance").alias("most"))
    return own.join(best, "file").where((F.col("relevance") > 0) | (F.col("most") == 0)).drop("most")


def suggestions(terms: DataFrame, query: str, most: int = 5) -> DataFrame:
    """term, score of the index terms that begin a query term or begin with one; score is the shared part."""
    q = query_terms(terms.sparkSession, query).select(F.col("term").alias("q"))
    near = terms.select("term").distinct().join(F.broadcast(q), F.startswith("term", "q") | F.startswith("q", "term"))
    share = F.least(F.length("term"), F.length("q")) / F.greatest(F.length("term"), F.length("q"))
    return near.groupBy("term").agg(F.max(share).alias("score")).where(F.col("score") > CLOSE).select("term", half_up(F.col("score"), 6).alias("score")).orderBy(F.desc("score"), "term").limit(most)
