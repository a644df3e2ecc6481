"""A training corpus from ``documents``, stage by stage.

Each stage reads all that the one before kept, from Parquet in the folder that
the cluster's executors share. All but the last return the columns of
``documents``; the last returns the place of every piece in its pack.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lattica.functions.lineage import checkpoint_dir
from lattica.llm import line_dedup, mixing, ngram_join, packing, quality_rules


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail no quality rule."""
    return quality_rules.keep_good(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines of recurring templates but in the first document that has them.

    So a document with many copies stays whole once, for the next stage.
    """
    return line_dedup.drop_recurring(docs, keep="first")


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of least doc_id, of each group of near copies."""
    return ngram_join.drop_near_copies(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The registered mixture: equal parts of the sources, in tokens, as far as each holds them."""
    return mixing.select_target(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """pack_id, pack_offset, doc_id, piece, start, length of every piece."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules_stage),
    ("line dedup", line_dedup_stage),
    ("n-gram Jaccard join", ngram_join_stage),
    ("mixing sources", mixing_stage),
    ("packing", packing_stage),
]

#: SQL can't express the n-gram join's trie, the knapsack or the packing; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole of ``documents``."""
    folder = f"{checkpoint_dir(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    return STAGES[-1][1](spark, docs, sf_dir)
