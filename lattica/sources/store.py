"""A code graph on disk: a Parquet folder per table, and when and from which commit it was made.

Tables and metadata lie in one folder of any file system that the session knows.
"""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.sql import SparkSession

from ..plans.graph import CodeGraph

TABLES = ("files", "exports", "edges", "symbols", "call_edges")
FOLDER = ".lattica"


def _at(spark: SparkSession, place: str):
    """(file system, path) of the session's Hadoop configuration."""
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _exists(spark: SparkSession, place: str) -> bool:
    files, path = _at(spark, place)
    return files.exists(path)


def save(graph: CodeGraph, folder: str, head: str) -> None:
    """Writes all tables, then the metadata: a folder without metadata isn't a graph."""
    spark = graph.files.sparkSession
    files, meta = _at(spark, f"{folder}/meta.json")
    files.delete(meta, False)
    for name in TABLES:
        getattr(graph, name).write.mode("overwrite").parquet(f"{folder}/{name}")
    made = {"head": head, "at": datetime.now(UTC).isoformat(), "version": 1}
    out = files.create(meta, True)
    try:
        out.write(bytearray(json.dumps(made).encode()))
    finally:
        out.close()


def _metadata(spark: SparkSession, folder: str) -> dict | None:
    if not _exists(spark, f"{folder}/meta.json") or not all(_exists(spark, f"{folder}/{name}") for name in TABLES):
        return None
    return json.loads(spark.read.text(f"{folder}/meta.json", wholetext=True).first()[0])


def load(spark: SparkSession, folder: str) -> tuple[CodeGraph, str] | None:
    """(graph, head), or None where a table or the metadata is missing."""
    made = _metadata(spark, folder)
    return made and (CodeGraph(**{name: spark.read.parquet(f"{folder}/{name}") for name in TABLES}), made["head"])


def usable(spark: SparkSession, folder: str, head: str, force: bool = False) -> CodeGraph | None:
    """The saved graph, if it is of this commit and a new one isn't forced. A changed work tree doesn't count."""
    if force or head == "unknown":
        return None
    found = load(spark, folder)
    return found[0] if found and found[1] == head else None


def status(spark: SparkSession, folder: str) -> dict | None:
    found = load(spark, folder)
    if found is None:
        return None
    graph, head = found
    return {"head": head, "at": _metadata(spark, folder)["at"]} | {name: getattr(graph, name).count() for name in TABLES}


def clean(spark: SparkSession, folder: str) -> bool:
    """Removes the folder; whether there was one."""
    files, path = _at(spark, folder)
    return files.delete(path, True)
