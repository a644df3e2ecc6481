"""The registered mixture: small sources don't shrink it, the shortfall goes to the others."""

import collections
import random

import pytest

import corpus_pipeline
from lattica.llm import mixing

from .test_operators import prose, table


def size(text):
    return len(text.split())


def brute_budgets(held, total):
    """Tokens of each source at equal weights: what a source can't fill is shared again."""
    budget, open_ = {}, dict(held)
    while open_:
        each = (total - sum(budget.values())) / len(open_)
        full = {s: n for s, n in open_.items() if n <= each}
        if not full:
            return budget | {s: each for s in open_}
        budget |= full
        open_ = {s: n for s, n in open_.items() if s not in full}
    return budget


def documents(tiny, hot):
    r = random.Random(8)
    rows = [(i, prose(r, 1 + i % 7), f"s{i % 4}") for i in range(400)]
    rows += [(1000, "five tokens are in here", None)] * tiny
    return rows + [(2000 + i, prose(r, 1 + i % 7), "hot") for i in range(400)] * hot


@pytest.mark.parametrize("tiny, hot", [(0, 0), (1, 0), (0, 1), (1, 1)])
def test_query_and_stage_meet_the_target(spark, tmp_path, tiny, hot):
    rows = documents(tiny, hot)
    held = collections.Counter()
    for _, t, s in rows:
        held[s] += size(t)
    total = sum(held.values()) * mixing.TOTAL_PART
    want = brute_budgets(held, total)
    docs = table(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = collections.Counter()
    for x in mixing.query(spark, str(tmp_path)).collect():
        got[x["source"]] += x["n_tokens"]
    assert set(got) == set(held)
    assert all(want[s] - 2 < got[s] <= want[s] + 1e-6 for s in held), (want, got)
    assert total - 2 * len(held) < sum(got.values()) <= total
    staged = collections.Counter()
    for x in dict(corpus_pipeline.STAGES)["mixing sources"](spark, docs, str(tmp_path)).collect():
        staged[x["source"]] += size(x["text"])
    assert staged == got


def test_weights_of_others_and_a_total_beyond_what_is_held(spark):
    docs = table(spark, documents(1, 1))
    assert mixing.select_mixture(docs, total=10**9).count() == docs.count()
    got = collections.Counter()
    for x in mixing.select_mixture(docs, {"hot": 3.0, "s0": 0.0, None: 1.0}, total=600, rest=1.0).collect():
        got[x["source"]] += size(x["text"])
    assert got[None] == 5 and got["s0"] == 0
    assert all(abs(got[s] - w * 595 / 6) < 2 for s, w in (("hot", 3), ("s1", 1), ("s2", 1), ("s3", 1)))
