"""The n-gram join leaves out no link, also where min-hash bands miss it."""

import itertools
import random

import pytest

import corpus_pipeline
from lattica.llm import ngram_join

from .test_operators import brute_links, ids, jaccard_sets, near_rows, prose, table


def pairs_at_the_threshold(n):
    """Pairs of texts of 60 n-grams each, 40 of them common: Jaccard 0.5. The bands miss 6 of 100 such pairs."""
    rows = []
    for k in range(n):
        common = " ".join(f"c{k}x{i}" for i in range(42))
        rows += [(2 * k + s, " ".join([common, *(f"{'ab'[s]}{k}x{i}" for i in range(20))]), "a") for s in (0, 1)]
    return rows


def test_links_at_the_threshold_are_all_found(spark):
    docs = table(spark, pairs_at_the_threshold(200))
    got = sorted(map(tuple, ngram_join.near_documents(docs).collect()))
    assert got == [(i, i // 2 * 2, 1) for i in range(400)]
    assert ids(corpus_pipeline.ngram_join_stage(spark, docs, "")) == list(range(0, 400, 2))


def mixed_rows(seed):
    r = random.Random(seed)
    rows = near_rows(seed)[:150]
    passage, i = prose(r, 30), 10_000
    for k in range(40):
        # short texts, shared passages and texts of up to twice another's length
        texts = [prose(r, r.randrange(1, 6)), f"{passage} {prose(r, r.randrange(5, 60))}", prose(r, 40)]
        texts.append(texts[2] + " " + prose(r, r.choice([10, 30, 38, 39, 40, 41, 60])))
        rows += [(i + j, t, "a") for j, t in enumerate(texts)]
        i += 4
    return rows


@pytest.mark.parametrize("seed, sizes", [(1, {}), (2, {"bucket_grams": 500, "often": 1}), (3, {"often": 2, "at_once": 50})])
def test_exact_candidates_hold_every_link(spark, seed, sizes):
    rows = mixed_rows(seed)
    docs = table(spark, rows)
    signed = ngram_join.signatures(docs).cache()
    sets = signed.drop("doc_id", "th").dropDuplicates(["set_id"])
    of = {r["doc_id"]: r["set_id"] for r in signed.select("doc_id", "set_id").collect()}
    # no groups known: the prefixes alone have to bring all linked sets together
    got = {frozenset(r) for r in ngram_join.missed_edges(docs, sets, spark.createDataFrame([], "node long, component long"), **sizes).collect()}
    want = {frozenset((of[i], of[j])) for (i, x), (j, y) in itertools.combinations(jaccard_sets(rows), 2) if of[i] != of[j] and len(x & y) / len(x | y) >= ngram_join.THRESHOLD}
    assert want <= got and len(want) > 50
    assert sorted(map(tuple, ngram_join.near_documents(docs).collect())) == brute_links(rows)[0]
