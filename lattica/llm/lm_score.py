"""LM scoring: context-tree weighting over bytes, trained on the whole corpus.

A byte is eight binary decisions; each of the 255 nodes of that decision tree
has a context tree over the bytes before, down to ``DEPTH``. The counts of all
documents give every tree node its Krichevsky-Trofimov estimate, and from the
leaves up each node's weighted probability is half its own estimate plus half
its children's product. The posterior weights this leaves mix the estimates of
all depths into one code length for every (context, byte), and a document's
score is its mean code length, in bits a byte.

Counts of byte grams meet by shuffle; subtrees of one last byte are weighted
side by side, and only the roots (256 x 255 numbers) meet on the driver. The
finished table is broadcast while it has at most ``BROADCAST_GRAMS`` entries,
and joined to the documents' gram counts beyond that.

Defined results: ``doc_id`` is a column of integers. A null or empty text has no
bytes and a null score; one of any length is read whole. Contexts
reach back over the start of a text as zero bytes. With a ``reference`` other
than the documents themselves, a gram the reference lacks costs what its
longest known suffix costs, and eight bits if none is known. Rows are scored
each, also those that repeat a doc_id, and equal texts score alike. An empty
table gives an empty result. Columns besides doc_id and text aren't read, so
their names don't matter.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import cut
from .common import chunks, table

DEPTH = 3
BROADCAST_GRAMS = 1 << 23


def grams(raw: np.ndarray, offsets: np.ndarray, depth: int) -> np.ndarray:
    """context * 256 + byte for each byte but the line feeds that end the texts; the nearest byte is the context's lowest."""
    kind = np.uint32 if depth <= 3 else np.uint64
    x = raw.astype(kind)
    code = x.copy()
    place = np.arange(len(raw)) - np.repeat(offsets[:-1], np.diff(offsets))
    for k in range(1, depth + 1):
        before = np.zeros(len(x), kind)
        before[k:] = x[:-k]
        before[place < k] = 0
        code += before << kind(8 * k)
    keep = np.ones(len(x), bool)
    keep[offsets[1:] - 1] = False
    return code[keep]


def _count(depth: int):
    def run(batches):
        import pyarrow as pa

        codes, counts, held = [], [], 0

        def merged():
            c, n = np.concatenate(codes), np.concatenate(counts)
            order = np.argsort(c, kind="stable")
            c, n = c[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
            return c[first], np.add.reduceat(n, first)

        for batch in batches:
            for _, _, raw, offsets in chunks(batch):
                got = grams(raw, offsets, depth)
                if len(got):
                    c, n = np.unique(got, return_counts=True)
                    codes.append(c)
                    counts.append(n)
                    held += len(c)
                if held > 1 << 22:
                    c, n = merged()
                    codes, counts, held = [c], [n], 0
        if codes:
            c, n = merged()
            for a in range(0, len(c), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(c[a : a + (1 << 16)].astype(np.int64)), pa.array(n[a : a + (1 << 16)].astype(np.int64))], ["code", "n"])

    return run


def gram_counts(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """code, n of all documents."""
    return docs.where("text IS NOT NULL").select("text").mapInArrow(_count(depth), "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x > 0, by Stirling's series from 8 on."""
    x = np.asarray(x, float).copy()
    shift = np.zeros_like(x)
    low = x < 8
    while low.any():
        shift[low] -= np.log(x[low])
        x[low] += 1
        low = x < 8
    i = 1 / x
    return shift + (x - 0.5) * np.log(x) - x + 0.9189385332046727 + i / 12 - i**3 / 360 + i**5 / 1260 - i**7 / 1680


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov probability of a zeros and b ones."""
    return _lgamma(a + 0.5) + _lgamma(b + 0.5) - _lgamma(a + b + 1.0) - np.log(np.pi)


def _decisions(byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(heap node from 1, bit) of the eight decisions of each byte, a row per byte."""
    level = np.arange(8)
    node = (1 << level) + (byte[:, None].astype(np.int64) >> (8 - level))
    return node, (byte[:, None].astype(np.int64) >> (7 - level)) & 1


class _Subtree:
    """Contexts of depth 1 and more that share their nearest byte, weighted from the leaves up."""

    def __init__(self, code: np.ndarray, n: np.ndarray, depth: int) -> None:
        order = np.argsort(code)
        self.code, n = code[order].astype(np.int64), n[order].astype(np.float64)
        node, self.bit = _decisions(self.code & 255)
        context = self.code >> 8
        self.kt, self.weight = [], []
        below = None
        for d in range(depth, 0, -1):
            key = ((context & ((1 << 8 * d) - 1))[:, None] << 8) | node
            keys, at = np.unique(key, return_inverse=True)
            at = at.reshape(key.shape)
            flat, bit, count = at.ravel(), self.bit.ravel(), np.repeat(n, 8)
            zero = np.bincount(flat, count * (bit == 0), len(keys))
            one = np.bincount(flat, count * (bit == 1), len(keys))
            own = log_kt(zero, one)
            if below is None:
                both, weight = own, np.ones(len(keys))
            else:
                child_keys, child_log = below
                parent = np.searchsorted(keys, ((child_keys >> 8) & ((1 << 8 * d) - 1)) << 8 | (child_keys & 255))
                deeper = np.bincount(parent, child_log, len(keys))
                both = np.logaddexp(own, deeper) - np.log(2)
                weight = np.exp(own - np.log(2) - both)
            below = keys, both
            p_one = (one + 0.5) / (zero + one + 1)
            self.kt.append(np.where(self.bit == 1, p_one[at], 1 - p_one[at]))
            self.weight.append(weight[at])
            self.top = keys & 255, both, zero, one

    def bits(self, root_weight: np.ndarray, root_one: np.ndarray) -> np.ndarray:
        """Code length of each gram, in bits."""
        p = self.kt[0]
        for kt, w in zip(self.kt[1:], self.weight[1:]):
            p = w * kt + (1 - w) * p
        node, _ = _decisions(self.code & 255)
        w = root_weight[node]
        root = np.where(self.bit == 1, root_one[node], 1 - root_one[node])
        return -np.log2(w * root + (1 - w) * p).sum(1)


def code_lengths(counts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """code, bits: the code length of every byte in every context seen."""
    near = counts.withColumn("near", F.shiftrightunsigned("code", 8).bitwiseAND(F.lit(255)).cast("int"))

    def roots(t):
        import pyarrow as pa

        node, log, zero, one = _Subtree(np.asarray(t.column("code")), np.asarray(t.column("n")), depth).top
        return pa.table({"node": pa.array(node.astype(np.int32)), "log": pa.array(log), "zero": pa.array(zero), "one": pa.array(one)})

    root_log, zero, one = np.zeros(256), np.zeros(256), np.zeros(256)
    for r in near.groupBy("near").applyInArrow(roots, "node int, log double, zero double, one double").orderBy("node", "log", "zero").collect():  # at most 256 x 255 rows
        root_log[r["node"]] += r["log"]
        zero[r["node"]] += r["zero"]
        one[r["node"]] += r["one"]
    own = log_kt(zero, one)
    both = np.logaddexp(own, root_log) - np.log(2)
    weight, p_one = np.exp(own - np.log(2) - both), (one + 0.5) / (zero + one + 1)

    def lengths(t):
        import pyarrow as pa

        tree = _Subtree(np.asarray(t.column("code")), np.asarray(t.column("n")), depth)
        return pa.table({"code": pa.array(tree.code), "bits": pa.array(tree.bits(weight, p_one))})

    return near.groupBy("near").applyInArrow(lengths, "code long, bits double")


class Table:
    """Code lengths by gram; grams that are missing fall back on the commonest byte's context one byte shorter."""

    def __init__(self, code: np.ndarray, bits: np.ndarray, n: np.ndarray, depth: int) -> None:
        kind = np.uint32 if depth <= 3 else np.uint64
        self.steps = []
        for d in range(depth, -1, -1):
            key = code.astype(np.int64) & ((1 << 8 * (d + 1)) - 1)
            keys, at = np.unique(key, return_inverse=True)
            mean = np.bincount(at, bits * n) / np.bincount(at, n)
            self.steps.append((keys.astype(kind), mean, kind((1 << 8 * (d + 1)) - 1)))

    def __call__(self, code: np.ndarray) -> np.ndarray:
        out = np.full(len(code), 8.0)
        left = np.arange(len(code))
        for keys, bits, mask in self.steps:
            if not len(left) or not len(keys):
                break
            part = code[left] & mask
            at = np.minimum(np.searchsorted(keys, part), len(keys) - 1)
            hit = keys[at] == part
            out[left[hit]] = bits[at[hit]]
            left = left[~hit]
        return out


def score(docs: DataFrame, reference: DataFrame | None = None, depth: int = DEPTH, broadcast_grams: int = BROADCAST_GRAMS) -> DataFrame:
    """doc_id, n_bytes, bits_per_byte of every document under the model of ``reference`` (the documents themselves, if None)."""
    spark = docs.sparkSession
    counts = cut(gram_counts(docs if reference is None else reference, depth))
    model = cut(code_lengths(counts, depth).join(counts, "code"))
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    if model.count() > broadcast_grams:
        return _score_by_join(rows, model, depth)
    got = model.toArrow()
    fixed = spark.sparkContext.broadcast(Table(np.asarray(got.column("code")), np.asarray(got.column("bits")), np.asarray(got.column("n"), dtype=float), depth))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for lo, hi, raw, offsets in chunks(batch):
                size = np.diff(offsets) - 1
                total = np.concatenate([[0.0], np.cumsum(fixed.value(grams(raw, offsets, depth)))])
                end = np.cumsum(size)
                mean = (total[end] - total[end - size]) / np.maximum(size, 1)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(size.astype(np.int64)), pa.array(np.floor(mean * 1e6 + 0.5) / 1e6, mask=size == 0)], ["doc_id", "n_bytes", "bits_per_byte"])

    return rows.mapInArrow(run, "doc_id long, n_bytes long, bits_per_byte double")


def _score_by_join(rows: DataFrame, model: DataFrame, depth: int) -> DataFrame:
    """The same by a shuffle: the documents' gram counts meet the table's rows, one depth after the other."""

    def split(batches):
        import pyarrow as pa

        for batch in batches:
            for lo, hi, raw, offsets in chunks(batch, 1 << 19):
                code = grams(raw, offsets, depth).astype(np.int64)
                owner = np.repeat(np.arange(hi - lo), np.diff(offsets) - 1)
                order = np.lexsort((code, owner))
                code, owner = code[order], owner[order]
                first = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])])) if len(code) else np.zeros(0, np.int64)
                times = np.diff(np.append(first, len(code)))
                part = batch.slice(lo, hi - lo).take(pa.array(owner[first]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("th"), pa.array(code[first]), pa.array(times.astype(np.int64))], ["doc_id", "th", "code", "times"])

    keyed = rows.withColumn("th", F.xxhash64("text"))
    left = keyed.where("text IS NOT NULL").dropDuplicates(["doc_id", "th"]).mapInArrow(split, "doc_id long, th long, code long, times long")
    costs = None
    for d in range(depth, -1, -1):
        mask = F.lit((1 << 8 * (d + 1)) - 1)
        step = model.groupBy(F.col("code").bitwiseAND(mask).alias("part")).agg((F.sum(F.col("bits") * F.col("n")) / F.sum("n")).alias("b"))
        left = left.withColumn("part", F.col("code").bitwiseAND(mask))
        left = left.drop("b").join(step, "part", "left") if costs is None else left.join(step.withColumnRenamed("b", "b2"), "part", "left").withColumn("b", F.coalesce("b", "b2")).drop("b2")
        costs = left = left.drop("part")
    sums = costs.groupBy("doc_id", "th").agg(F.sum("times").alias("n_bytes"), F.sum(F.col("times") * F.coalesce("b", F.lit(8.0))).alias("bits"))
    sums = sums.select(F.col("doc_id").alias("i"), F.col("th").alias("t"), "n_bytes", "bits")
    full = keyed.select("doc_id", "th").join(sums, F.col("doc_id").eqNullSafe(F.col("i")) & F.col("th").eqNullSafe(F.col("t")), "left")
    return full.select("doc_id", F.coalesce("n_bytes", F.lit(0)).cast("long").alias("n_bytes"), (F.floor(F.col("bits") / F.col("n_bytes") * 1e6 + 0.5) / 1e6).alias("bits_per_byte"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
