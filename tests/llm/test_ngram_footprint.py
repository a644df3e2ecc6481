"""What the n-gram join moves and holds grows with the input, not faster."""

import random
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pytest

from lattica.llm import ngram_join

from .test_operators import table


def unlike_rows(n, words=60):
    r = random.Random(n)
    return [(i, " ".join(f"w{r.randrange(10**9)}" for _ in range(words)), "a") for i in range(n)]


@pytest.mark.parametrize("step", ["sign", "tags", "prefixes", "grams"])
def test_workers_hold_little_beside_a_batch(step):
    import pyarrow as pa

    texts = [t for _, t, _ in unlike_rows(10_000, 45)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "th": list(range(len(texts))), "text": texts})
    shared = SimpleNamespace(value=np.zeros((64, 1 << 10), np.uint8))
    run = {"sign": lambda: ngram_join._sign(3), "tags": lambda: ngram_join._tags(3, 64), "prefixes": lambda: ngram_join._prefixes(3, 0.5, shared), "grams": lambda: ngram_join._grams(3)}[step]()
    tracemalloc.start()
    rows = sum(b.num_rows for b in run([batch]))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # no n-gram of these recurs, so no set has a prefix to send
    assert (rows > 0) == (step != "prefixes") and batch.nbytes > 1 << 22
    assert most < 64 << 20


def shuffled_bytes(spark):
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty(30_000)
    stages = context.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_bands_move_without_their_sketches(spark):
    sets = ngram_join.cut(ngram_join.signatures(table(spark, unlike_rows(2000))).drop("doc_id", "th"))
    # with many partitions the rows of a set go apart, and what they repeat doesn't compress
    conf = {"spark.sql.shuffle.partitions": "200", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        before = shuffled_bytes(spark)
        assert ngram_join.candidate_edges(sets).count() == 0
        moved = (shuffled_bytes(spark) - before) / (2000 * ngram_join.BANDS)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    # 33 bytes a band here; 64 with the sketches
    assert moved < 48


def grams_of(text):
    raw = np.frombuffer((text + "\n").encode(), np.uint8)
    return ngram_join.gram_sets(ngram_join.WordHasher(), raw, np.array([0, len(raw)]), 3)[0]


def test_levels_tell_single_ngrams_where_others_recur(spark):
    # 1000 n-grams that occur twice and 11,600 single ones, in a table of 2 KB
    again = [" ".join(f"c{i}x{k}" for k in range(52)) for i in range(20)]
    single = [t for _, t, _ in unlike_rows(200)]
    texts = table(spark, [(i, t, "a") for i, t in enumerate([*again, *again, *single])]).select("text")
    levels = ngram_join.gram_levels(texts, 3, 1, 1 << 13)
    assert levels.nbytes == 1 << 11
    level = [np.concatenate([ngram_join._level(levels, grams_of(t)) for t in x]) for x in (again, single)]
    assert (level[0] == 1).all()
    # a slot to a byte would hide 0.39 of the single ones
    assert np.mean(level[1] > 0) < 0.15
