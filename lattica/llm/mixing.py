"""Mixing sources to target weights: subset-sum budget fitting.

Documents are counted by source and exact token length. A source's budget is
its weight's share of the total; a source that holds less gives all it holds,
and the others share what it leaves by their weights. From each source's length
histogram a proportional share of every length is taken first, the longest
lengths that still fit are added next, and bounded-knapsack dynamic programming
fills the rest of the budget. The rest is wide enough where the sum meets the
budget, or the largest multiple of the lengths' common divisor under it, as no
sum can do better; else it is made wider, up to what is proven to hold a best
sum (``_certain``). So the sum is the best there is at every size. Of each
length the documents with the least seeded hash are selected, by count.

Only histograms meet in one task (one per source); documents are compared with
their length's cut-off, which is found by counts of hash ranges, so no task
ranks a source or a length.

Defined results: ``doc_id`` may be of any type. Rows without source form a
source of their own (null). A document without tokens (null, empty or blank
text) is never selected, as it adds nothing; a very long one is if it fits.
Weights of 0 or of absent sources select nothing, and a target of more than is
held selects all. Rows alike in source, length and hash (the hash is of doc_id
and text) are interchangeable: as many are taken as counted. An empty table
gives an empty result. Columns with clashing names pass through unread.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut
from .common import bounded, packed, table, tokens_of, unpacked

#: ``SHARE`` holds for calls without a target only; the query and the pipeline have one.
SEED, SHARE = 17, 0.9
#: The registered target: of all sources, null too, equal parts (``WEIGHTS`` names those that
#: differ, all others weigh 1), and in all this part of the tokens held.
WEIGHTS: dict[str | None, float] = {}
TOTAL_PART = 0.9
#: What is left of a budget when dynamic programming takes over, at first.
KNAPSACK = 1 << 16
#: Bits of the seeded hash that make a range of hashes.
RANGE_BITS = 12


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int, window: int = KNAPSACK) -> np.ndarray:
    """How many documents of each length to take so that their sum is the largest one up to ``budget``."""
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    if budget <= 0:
        return np.zeros_like(counts)
    some = (counts > 0) & (lengths <= budget)
    if not some.any():
        return np.zeros_like(counts)
    divisor = int(np.gcd.reduce(lengths[some]))
    most = min(budget // divisor * divisor, int((lengths * counts)[some].sum()))
    base = _certain(lengths, counts, budget)
    widest = budget - int((base * lengths).sum())
    while window < widest:
        take = _fit(lengths, counts, budget, window)
        if int((take * lengths).sum()) == most:
            return take
        window *= 4
    return base + _knapsack(lengths, counts - base, widest)


def _certain(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Counts that some best selection takes at least.

    Let x be a selection that no document fits any more, so that less than the
    longest length d is left, and z the best one nearest to it. Add what z has
    more while the sum is at most 0, else take away what it has less: the sums on
    the way lie from 1 - d to d. If one came twice, z without the steps between
    would be as good and nearer. So z and x differ in fewer than 2 d documents.
    """
    take = np.floor(counts * (budget / int((lengths * counts).sum()) * (1 - 1e-12))).astype(np.int64)
    rest = budget - int((take * lengths).sum())
    for i in np.argsort(-lengths):
        add = min(int(counts[i] - take[i]), rest // int(lengths[i]))
        take[i] += add
        rest -= add * int(lengths[i])
    return np.maximum(0, take - 2 * int(lengths[counts > 0].max()))


def _fit(lengths: np.ndarray, counts: np.ndarray, budget: int, window: int) -> np.ndarray:
    """Dynamic programming over the last ``window`` tokens of the budget."""
    if budget <= window:
        return _knapsack(lengths, counts, budget)
    total = int((lengths * counts).sum())
    # the proportional share leaves a document of each length over, and at least half the window open
    take = np.floor(counts * max(0.0, (budget - window // 2) / total)).astype(np.int64)
    rest = budget - int((take * lengths).sum())
    for i in np.argsort(-lengths):
        if rest <= window:
            break
        add = min(int(counts[i] - take[i]), (rest - window // 2) // int(lengths[i]))
        if add > 0:
            take[i] += add
            rest -= add * int(lengths[i])
    return take + _knapsack(lengths, counts - take, rest)


def _knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Bounded subset sum over ``budget`` by bit sets of reachable sums."""
    full = (1 << (budget + 1)) - 1
    reach, trail = 1, []
    for i in np.argsort(-lengths, kind="stable"):
        length, n = int(lengths[i]), min(int(counts[i]), budget // int(lengths[i]))
        k = 1
        while n > 0:
            k = min(k, n)
            grown = (reach | (reach << (length * k))) & full
            if grown != reach:
                trail.append((int(i), k, length, reach))
                reach = grown
            n -= k
            k *= 2
        if reach >> budget & 1:
            break
    at = reach.bit_length() - 1
    take = np.zeros_like(counts)
    for i, k, length, before in reversed(trail):
        if not before >> at & 1:
            take[i] += k
            at -= length * k
    return take


def _hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "doc_id", "text")


def budgets(histogram: DataFrame, weights: Mapping[str | None, float] | None, total: int | None, share: float, part: float | None = None, rest: float = 0.0) -> DataFrame:
    """source, budget. Without ``weights`` all sources weigh alike; a source that they don't name weighs ``rest``.

    The total is ``total`` tokens, or ``part`` of all that the sources of positive weight hold. With neither it
    is ``share`` of the largest total for which every source of positive weight can fill its part.
    """
    held = histogram.groupBy("source").agg(F.sum(F.col("length") * F.col("n")).alias("held"))
    if weights is None:
        held = held.withColumn("w", F.lit(1.0))
    else:
        pairs = [F.when(F.col("source").eqNullSafe(F.lit(s)), F.lit(float(w))) for s, w in weights.items()]
        held = held.withColumn("w", F.coalesce(*pairs, F.lit(float(rest))))
    every = held.agg(F.sum("w").alias("sum_w"), F.sum(F.when(F.col("w") > 0, F.col("held"))).alias("all"), F.min(F.when(F.col("w") > 0, F.col("held") / F.col("w"))).alias("least"))
    whole = F.lit(float(total)) if total is not None else F.col("all") * part if part is not None else F.col("least") * F.col("sum_w") * share
    goal = held.crossJoin(F.broadcast(every)).withColumn("whole", whole).where("w > 0")
    # by what a source holds a weight: up to a level all give what they hold, from there on each its weight's part (a row a source)
    by = Window.orderBy(F.col("held") / F.col("w"), "source").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("whole") - F.coalesce(F.sum("held").over(by), F.lit(0))) / (F.col("sum_w") - F.coalesce(F.sum("w").over(by), F.lit(0.0)))
    levels = goal.withColumn("level", level).withColumn("level", F.when(F.col("held") / F.col("w") >= F.col("level"), F.col("level")))
    found = levels.agg(F.max("level").alias("level"))
    return goal.crossJoin(F.broadcast(found)).select("source", F.coalesce(F.least(F.floor(F.col("level") * F.col("w") + 1e-6), "held"), "held").cast("long").alias("budget"))


def _cutoffs(ids: DataFrame, weights, total, share, part, rest) -> DataFrame:
    """source, length, cut, at_cut: rows under ``cut`` are taken, and ``at_cut`` of those at it."""
    histogram = ids.groupBy("source", "length").agg(F.count(F.lit(1)).alias("n"))
    goal = budgets(histogram, weights, total, share, part, rest)

    def fit(t):
        import pyarrow as pa

        lengths, counts = np.asarray(t.column("length"), dtype=np.int64), np.asarray(t.column("n"), dtype=np.int64)
        order = np.argsort(lengths)
        take = np.zeros_like(counts)
        take[order] = fit_counts(lengths[order], counts[order], t.column("budget")[0].as_py())
        return pa.table({"source": t.column("source"), "length": t.column("length"), "take": pa.array(take)})

    matched = histogram.withColumnRenamed("source", "s").join(goal, F.col("s").eqNullSafe(F.col("source"))).select("source", F.col("length").cast("long"), "n", "budget")
    take = matched.groupBy("source").applyInArrow(fit, "source string, length long, take long").where("take > 0").select(F.col("source").alias("s"), F.col("length").alias("l"), "take")
    # the range of hashes in which a length's count is reached, then the hash in it
    ranged = ids.withColumn("range", F.shiftright("h", 64 - RANGE_BITS))
    by = Window.partitionBy("source", "length").orderBy("range")
    ranges = ranged.groupBy("source", "length", "range").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.sum("n").over(by) - F.col("n"))
    hit = ranges.join(take, F.col("source").eqNullSafe(F.col("s")) & (F.col("length") == F.col("l"))).where((F.col("before") < F.col("take")) & (F.col("before") + F.col("n") >= F.col("take")))
    hit = hit.select("s", "l", F.col("range").alias("r"), "take", "before")
    rows = ranged.join(hit, F.col("source").eqNullSafe(F.col("s")) & (F.col("length") == F.col("l")) & (F.col("range") == F.col("r"))).groupBy("source", "length", "h", "take", "before").agg(F.count(F.lit(1)).alias("same"))
    upto = rows.withColumn("upto", F.col("before") + F.sum("same").over(Window.partitionBy("source", "length").orderBy("h")))
    met = upto.where((F.col("upto") >= F.col("take")) & (F.col("upto") - F.col("same") < F.col("take")))
    return met.select(F.col("source").alias("__lt_s"), F.col("length").alias("__lt_l"), F.col("h").alias("__lt_cut"), (F.col("take") - F.col("upto") + F.col("same")).alias("__lt_at"), F.col("same").alias("__lt_same"))


def select_mixture(docs: DataFrame, weights: Mapping[str | None, float] | None = None, total: int | None = None, share: float = SHARE, seed: int = SEED, part: float | None = None, rest: float = 0.0) -> DataFrame:
    """The selected rows of ``docs``, with its columns. ``weights``: by source, any positive scale; for the others see ``budgets``."""
    return unpacked(_select(docs, weights, total, share, seed, part, rest))


def select_target(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the registered target selects."""
    return select_mixture(docs, WEIGHTS, part=TOTAL_PART, rest=1.0)


def _plan(docs: DataFrame, weights, total, share, seed, part, rest) -> tuple[DataFrame, DataFrame]:
    """(source, length, h, doc_id of every document with tokens; the cut-offs), both kept."""
    keyed = cut(docs.select("source", tokens_of(F.col("text")).alias("length"), _hash(seed).alias("h"), "doc_id").where("length > 0"))
    return keyed, cut(_cutoffs(keyed.drop("doc_id"), weights, total, share, part, rest))


def _under(rows: DataFrame, cuts: DataFrame, source: str, length: str, h: str) -> DataFrame:
    """The rows up to their length's cut-off, and of those at it as many as it takes."""
    # a row for each source and length
    near = rows.join(bounded(cuts), F.col(source).eqNullSafe(F.col("__lt_s")) & (F.col(length) == F.col("__lt_l")) & (F.col(h) <= F.col("__lt_cut")))
    if cuts.where("__lt_at < __lt_same").isEmpty():
        return near
    # rows at a cut-off that aren't all taken have one text and doc_id; they are ranked among themselves
    tied = (F.col(h) == F.col("__lt_cut")) & (F.col("__lt_at") < F.col("__lt_same"))
    ranked = near.where(tied).withColumn("__lt_r", F.row_number().over(Window.partitionBy(source, length).orderBy(h))).where("__lt_r <= __lt_at").drop("__lt_r")
    return near.where(~tied).unionByName(ranked)


def _select(docs: DataFrame, weights, total, share, seed, part, rest) -> DataFrame:
    # the texts are read twice: once for lengths and hashes, once to select
    _, cuts = _plan(docs, weights, total, share, seed, part, rest)
    rows = packed(docs, __lt_s0=F.col("source"), __lt_l0=tokens_of(F.col("text")), __lt_h=_hash(seed))
    return _under(rows.where("__lt_l0 > 0"), cuts, "__lt_s0", "__lt_l0", "__lt_h")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens of the documents selected for the registered target."""
    keyed, cuts = _plan(table(spark, sf_dir, "documents"), WEIGHTS, None, SHARE, SEED, TOTAL_PART, 1.0)
    return _under(keyed, cuts, "source", "length", "h").select("doc_id", "source", F.col("length").alias("n_tokens"))
