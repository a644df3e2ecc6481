"""Finding source files: a walk on the driver, their texts read by the executors."""

from __future__ import annotations

import json
import os
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SKIPPED = {".git", "node_modules", ".lattica"}


def ignore_patterns(root: str) -> list[str]:
    """The plain lines of a .gitignore; globs and negations aren't understood and match nothing but themselves."""
    try:
        lines = Path(root, ".gitignore").read_text(encoding="utf-8").splitlines()
    except OSError:
        return []
    return [x.strip().rstrip("/") for x in lines if x.strip() and not x.strip().startswith("#")]


def ignored(relative: str, patterns: list[str]) -> bool:
    parts = relative.split("/")
    return any(p in parts or relative == p.lstrip("/") or relative.startswith(p.lstrip("/") + "/") for p in patterns)


def source_paths(root: str) -> list[str]:
    """Relative paths of .ts and .tsx files but declarations, in walking order.

    Links are followed, each real folder once; broken links are passed over.
    """
    patterns, seen, found = ignore_patterns(root), set(), []

    def walk(folder: str) -> None:
        real = os.path.realpath(folder)
        if real in seen:
            return
        seen.add(real)
        try:
            names = sorted(os.listdir(folder))
        except OSError:
            return
        for name in names:
            path = os.path.join(folder, name)
            relative = os.path.relpath(path, root).replace(os.sep, "/")
            if name in SKIPPED or ignored(relative, patterns) or not os.path.exists(path):
                continue
            if os.path.isdir(path):
                walk(path)
            elif name.endswith((".ts", ".tsx")) and not name.endswith(".d.ts"):
                found.append(relative)

    walk(root)
    return found


def path_aliases(root: str) -> list[tuple[str, str]]:
    """(prefix, replacement) of tsconfig's ``paths``, by the first target of each; comments are allowed, errors give none."""
    try:
        text = Path(root, "tsconfig.json").read_text(encoding="utf-8")
        text = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m.group(1) or "", text, flags=re.DOTALL)
        options = json.loads(re.sub(r",(\s*[}\]])", r"\1", text)).get("compilerOptions", {})
        base = options.get("baseUrl", ".")
        return [(k.replace("*", ""), os.path.normpath(os.path.join(base, v[0].replace("*", ""))).replace(os.sep, "/") + ("/" if v[0].endswith("/*") else "")) for k, v in options.get("paths", {}).items() if v]
    except (OSError, ValueError, AttributeError, TypeError):
        return []


def read_sources(spark: SparkSession, root: str) -> DataFrame:
    """path, text, ord of a source tree; raises where there is none."""
    if not os.path.isdir(root):
        raise FileNotFoundError(f"No such directory: {root}")
    paths = source_paths(root)
    if not paths:
        raise ValueError(f"No TypeScript files in {root}")
    order = spark.createDataFrame([(p, i) for i, p in enumerate(paths)], "path string, ord long")
    # the walk may have followed links, so files are named one by one
    raw = spark.read.format("binaryFile").load([str(Path(root, p).resolve()) for p in paths])
    real = spark.createDataFrame([(p, Path(root, p).resolve().as_uri()) for p in paths], "path string, uri string")
    plain = F.regexp_replace(F.col("raw_path"), "^file:/*", "file:///")
    texts = raw.select(F.col("path").alias("raw_path"), F.decode("content", "UTF-8").alias("text")).select(plain.alias("uri"), "text").dropDuplicates(["uri"])
    # Spark's readers pass over empty files
    return real.join(texts, "uri", "left").join(order, "path").select("path", F.coalesce("text", F.lit("")).alias("text"), "ord")
