"""Commit logs, diffs and heads of a git work tree, read on the driver; failures give empty results."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG_SECONDS, DIFF_SECONDS = 30, 5
SCOPES = {"staged": ["diff", "--cached", "--name-only"], "unstaged": ["diff", "--name-only"]}


def _git(root: str, args: list[str], seconds: int) -> str | None:
    try:
        done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, timeout=seconds, check=True)
    except (OSError, subprocess.SubprocessError):
        return None
    return done.stdout


def _paths(spark: SparkSession, text: str | None) -> DataFrame:
    return spark.createDataFrame([(x.strip(),) for x in (text or "").splitlines() if x.strip()], "file string")


def touched(spark: SparkSession, root: str) -> DataFrame:
    """file, once for each commit that touches it."""
    return _paths(spark, _git(root, ["log", "--all", "--name-only", "--format="], LOG_SECONDS))


def churn(touches: DataFrame) -> DataFrame:
    return touches.groupBy("file").agg(F.count(F.lit(1)).alias("churn"))


def changed(spark: SparkSession, root: str, scope: str = "all") -> DataFrame:
    """file of a diff: ``staged``, ``unstaged``, or anything else for both."""
    out = _git(root, SCOPES.get(scope, ["diff", "HEAD", "--name-only"]), DIFF_SECONDS)
    if out is None:
        raise RuntimeError("Git not available or not in a git repository")
    return _paths(spark, out)


def head(root: str) -> str:
    return (_git(root, ["rev-parse", "HEAD"], DIFF_SECONDS) or "unknown").strip()
