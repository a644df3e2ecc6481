"""The pipeline against a brute-force version of its stages, each on its own input."""

import collections
import itertools
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lattica.llm import line_dedup, mixing, ngram_join, packing, quality_rules
from lattica.llm.common import tokens_of

from .test_mixing_target import brute_budgets
from .test_operators import SCHEMA, brute_line_dedup, jaccard_sets, prose, simple_spfhp


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(12)
    rows, i = [], 0
    for k in range(60):
        base = prose(r, r.randrange(5, 120)).split()
        for c in range(r.choice([1, 1, 1, 3, 12])):
            w = list(base)
            for _ in range(c % 3 * len(w) // 50):
                w[r.randrange(len(w))] = "edited"
            lines = [" ".join(w), f"all rights of page {i} are reserved here"] if k % 2 else [" ".join(w)]
            rows.append((i, "\n".join(lines), "abc"[k % 3]))
            i += 1
    rows += [(i, "### $$$ !!!", "a"), (i + 1, "", "b"), (i + 2, None, "c"), (3, rows[3][1], rows[3][2]), (None, "of the and " + prose(r, 30), None), (i + 3, "THE!! OF!! AND!!", "a")]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(a, t, "en", s, None if t is None else len(t)) for a, t, s in rows], SCHEMA).write.parquet(f"{path}/documents.parquet")
    return path


def texts(df):
    return sorted(map(repr, ((r["doc_id"], r["text"], r["source"], r["n_chars"]) for r in df.collect())))


def test_stages_against_brute_force(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, inputs = docs.columns, [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, inputs[-1], folder).write.parquet(f"{tmp_path}/{k}")
        inputs.append(spark.read.parquet(f"{tmp_path}/{k}"))
        assert k == 4 or inputs[-1].columns == columns
    first, good, lines, near, mixed, packed = inputs

    con = duckdb.connect()
    con.register("documents", first.toArrow())
    want = con.sql(f"WITH {quality_rules.metrics_sql()} SELECT doc_id, text, source, d.n_chars FROM (SELECT *, length(text) AS n_chars FROM (SELECT doc_id, text, source, failed FROM m)) d WHERE failed = ''").fetchall()
    assert texts(good) == sorted(map(repr, want)) and good.count() < first.count()

    rows = [(r["doc_id"], r["text"], r["source"]) for r in good.collect()]
    cleaned = brute_line_dedup(rows, "first")
    assert texts(lines) == sorted(map(repr, ((i, t, s, len(t)) for (i, _, s), t in zip(rows, cleaned))))
    assert sum(a != b for (_, a, _), b in zip(rows, cleaned)) > 5

    rows = [(r["doc_id"], r["text"], r["source"]) for r in lines.collect()]
    sets = jaccard_sets(rows)
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if len(x & y) / len(x | y) >= ngram_join.THRESHOLD:
            p, q = sorted((find(a), find(b)))
            root[q] = p
    bare = [i for i, t, _ in rows if i not in root]
    kept = [r["doc_id"] for r in near.collect()]
    assert sorted(kept, key=str) == sorted([*{find(i) for i in root}, *bare], key=str)

    # the sum of each source is the best there is under its budget, and of each length those of least hash are taken
    keyed = [tuple(r) for r in near.select("doc_id", "source", tokens_of(F.col("text")), F.xxhash64(F.lit(mixing.SEED), "doc_id", "text")).collect() if r[2]]
    held = collections.Counter()
    for _, s, n, _ in keyed:
        held[s] += n
    budget = brute_budgets(held, sum(held.values()) * mixing.TOTAL_PART)
    chosen = collections.Counter((r["doc_id"], r["source"]) for r in mixed.collect())
    assert mixed.count() < near.count() and set(s for _, s in chosen) == set(held)
    for s in held:
        sums, taken = 1, 0
        by = collections.defaultdict(list)
        for i, t, n, h in keyed:
            if t == s:
                by[n].append((h, i))
                sums |= sums << n
        for n, rows_ in by.items():
            mine = [(i, s) in chosen for _, i in sorted(rows_)]
            assert mine == sorted(mine, reverse=True)
            taken += n * sum(mine)
        limit = int(budget[s] + 1e-6)
        assert taken == max(x for x in range(limit + 1) if sums >> x & 1)

    spans = collections.defaultdict(list)
    for r in packed.collect():
        spans[r["pack_id"]].append((r["pack_offset"], r["length"]))
    assert sum(n for v in spans.values() for _, n in v) == sum(r[0] for r in mixed.select(tokens_of(F.col("text"))).collect())
    assert all(sum(n for _, n in v) <= packing.CAPACITY for v in spans.values())
    assert all([a for a, _ in sorted(v)] == [sum(n for _, n in sorted(v)[:k]) for k in range(len(v))] for v in spans.values())
    sizes = [r[0] for r in mixed.select(tokens_of(F.col("text"))).collect()]
    pieces = [x for n in sizes for x in [packing.CAPACITY] * (n // packing.CAPACITY) + [n % packing.CAPACITY] * (n % packing.CAPACITY > 0)]
    assert collections.Counter(n for v in spans.values() for _, n in v) == collections.Counter(pieces) and len(spans) <= len(simple_spfhp(pieces, packing.CAPACITY)) + 2
    assert sorted(map(tuple, packed.collect()), key=str) == sorted(map(tuple, corpus_pipeline.run(spark, folder).collect()), key=str)


def test_run_over_no_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_parameters_are_the_documented_ones():
    assert (line_dedup.MIN_DOCS, ngram_join.THRESHOLD, packing.CAPACITY) == (10, 0.5, 2048) and [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "n-gram Jaccard join", "mixing sources", "packing"]
