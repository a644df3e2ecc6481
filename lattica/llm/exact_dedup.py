"""Exact dedup: counting quotient filters per partition, merged without loss.

A fingerprint is the 64-bit xxHash of a text. Its top bits name a shard, the
next ones the quotient, the rest the remainder. Every input partition builds a
counting quotient filter per shard; filters of a shard merge by sorted
remainders into exact counts. Only texts whose fingerprint counts above one
are routed on, and their bytes are compared: equal texts are counted by partial
sums, so a group of copies of any size moves as one text a partition. Its rows
then meet it by fingerprint, or by text as well where texts share one.

Defined results: ``doc_id`` may be of any type that has an order. A null text is
no copy of anything; empty texts are copies of each other, and very long ones
like any other. Of equal texts the row with the least doc_id stays (a null only
if all are null); each other row, also one that repeats a doc_id, is one row of
the result. An empty table gives an empty result. Columns besides doc_id and
text aren't read, so their names don't matter.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import cut
from .common import bounded, table

_LOAD = 0.75


class CountingQuotientFilter:
    """Exact multiset of p-bit fingerprints in quotient form.

    ``occupied`` has a bit per quotient, ``run_ends`` a bit per slot (set on the
    last slot of each run), ``remainders`` the sorted remainders run after run,
    each in whole bytes, ``counts`` their counters. Slots hold no gaps, so a
    filter's size is that of its content.
    """

    def __init__(self, bits: int, quotient_bits: int, quotients: np.ndarray, remainders: np.ndarray, counts: np.ndarray) -> None:
        self.bits, self.q = bits, quotient_bits
        self.quotients, self.remainders, self.counts = quotients, remainders, counts

    @classmethod
    def build(cls, fingerprints: np.ndarray, counts: np.ndarray | None, bits: int) -> CountingQuotientFilter:
        """From fingerprints under 2**bits, each counted once or ``counts`` times."""
        if counts is None:
            keys, n = np.unique(fingerprints, return_counts=True)
        else:
            order = np.argsort(fingerprints, kind="stable")
            keys, n = fingerprints[order], counts[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
            keys, n = keys[first], np.add.reduceat(n, first) if len(keys) else n
        q = min(bits, max(1, int(np.ceil(np.log2(max(1, len(keys)) / _LOAD)))))
        r = np.uint64(bits - q)
        mask = np.uint64((1 << (bits - q)) - 1)
        keys = keys.astype(np.uint64)
        return cls(bits, q, keys >> r if bits > q else keys, keys & mask, n.astype(np.int64))

    def fingerprints(self) -> np.ndarray:
        return (self.quotients << np.uint64(self.bits - self.q)) | self.remainders

    @classmethod
    def merged(cls, filters: list[CountingQuotientFilter], bits: int) -> CountingQuotientFilter:
        """Their sum; a fingerprint's counts add up, nothing else changes."""
        return cls.build(np.concatenate([f.fingerprints() for f in filters]), np.concatenate([f.counts for f in filters]), bits)

    def to_bytes(self) -> bytes:
        occupied = np.zeros(1 << self.q, bool)
        occupied[self.quotients.astype(np.int64)] = True
        ends = np.concatenate([self.quotients[1:] != self.quotients[:-1], [True]]) if len(self.quotients) else np.zeros(0, bool)
        width = (self.bits - self.q + 7) // 8
        slots = self.remainders.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
        small = np.minimum(self.counts, 255).astype(np.uint8)
        head = np.array([self.bits, self.q, len(self.counts)], "<i8")
        return head.tobytes() + np.packbits(occupied).tobytes() + np.packbits(ends).tobytes() + slots.tobytes() + small.tobytes() + self.counts[small == 255].astype("<i8").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CountingQuotientFilter:
        bits, q, n = (int(x) for x in np.frombuffer(data, "<i8", 3))
        at = 24
        size = ((1 << q) + 7) // 8
        occupied = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, size, at))[: 1 << q])
        at += size
        size = (n + 7) // 8
        ends = np.unpackbits(np.frombuffer(data, np.uint8, size, at))[:n].astype(np.int64)
        at += size
        quotients = occupied[np.concatenate([[0], np.cumsum(ends)[:-1]])].astype(np.uint64) if n else np.zeros(0, np.uint64)
        width = (bits - q + 7) // 8
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(n, width)
        at += n * width
        counts = np.frombuffer(data, np.uint8, n, at).astype(np.int64)
        at += n
        over = counts == 255
        counts[over] = np.frombuffer(data, "<i8", int(over.sum()), at)
        return cls(bits, q, quotients, wide.view("<u8").ravel().astype(np.uint64), counts)


def _shard_bits(spark: SparkSession) -> int:
    """A shard per shuffle partition, so a shard stays small as the input and that setting grow."""
    return max(1, (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())


def repeated_fingerprints(fingerprints: DataFrame, shard_bits: int) -> DataFrame:
    """fp, n: the values of the one long column that occur more than once, with their counts."""
    bits = 64 - shard_bits

    def build(batches):
        import pyarrow as pa

        got = [np.asarray(b.column(0).drop_null()).view(np.uint64) for b in batches]
        fps = np.sort(np.concatenate(got)) if got else np.zeros(0, np.uint64)
        cut = np.searchsorted(fps, np.arange(1 << shard_bits, dtype=np.uint64) << np.uint64(bits))
        shards, blobs = [], []
        for s, (a, b) in enumerate(zip(cut, [*cut[1:], len(fps)])):
            if b > a:
                shards.append(s)
                blobs.append(CountingQuotientFilter.build(fps[a:b] & np.uint64((1 << bits) - 1), None, bits).to_bytes())
        yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array(blobs, pa.binary())], ["shard", "filter"])

    def merge(t):
        import pyarrow as pa

        if not t.num_rows:
            return pa.table({"fp": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        full = CountingQuotientFilter.merged([CountingQuotientFilter.from_bytes(b) for b in t.column("filter").to_pylist()], bits)
        many = full.counts > 1
        fp = full.fingerprints()[many] | (np.uint64(t.column("shard")[0].as_py()) << np.uint64(bits))
        return pa.table({"fp": pa.array(fp.view(np.int64)), "n": pa.array(full.counts[many])})

    return fingerprints.mapInArrow(build, "shard int, filter binary").groupBy("shard").applyInArrow(merge, "fp long, n long")


def exact_duplicates(docs: DataFrame, fingerprint: Column | None = None) -> DataFrame:
    """doc_id, kept_doc_id, copies: a row for each document that repeats the bytes of another that stays.

    ``fingerprint`` (a long of ``text``) is another than xxHash, for tests.
    """
    keyed = docs.where(F.col("text").isNotNull()).select("doc_id", "text", (F.xxhash64("text") if fingerprint is None else fingerprint).alias("fp"))
    many = cut(repeated_fingerprints(keyed.select("fp"), _shard_bits(docs.sparkSession)).select("fp"))
    grouped = keyed.join(bounded(many), "fp", "left_semi").groupBy("fp", "text").agg(F.min("doc_id").alias("kept_doc_id"), F.count(F.lit(1)).alias("copies"))
    narrow = cut(grouped.select("fp", "kept_doc_id", "copies"))
    # a fingerprint of one text stands for it; those of several, which are rare, go with their texts
    shared = cut(narrow.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("fp"))
    alone = cut(narrow.where("copies > 1").join(bounded(shared), "fp", "left_anti"))
    rows = keyed.select("doc_id", "fp", F.lit(None).cast("string").alias("other")).join(bounded(alone), "fp")
    if not shared.isEmpty():
        apart = keyed.join(bounded(shared), "fp", "left_semi")
        rows = rows.unionByName(apart.join(grouped.where("copies > 1"), ["fp", "text"]).withColumnRenamed("text", "other"))
    kept = F.col("doc_id").eqNullSafe(F.col("kept_doc_id"))
    # of rows with the doc_id that stays all but one are copies: n - 1 rows, made in two steps so that no array is long
    ties = rows.where(kept).groupBy("fp", "other", "kept_doc_id", "copies").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    more = ties.withColumn("k", F.explode(F.expr("sequence(0, (n - 2) div 4096)"))).withColumn("k", F.explode(F.expr("sequence(1, least(4096, n - 1 - k * 4096))")))
    return rows.where(~kept).select("doc_id", "kept_doc_id", "copies").unionByName(more.select(F.col("kept_doc_id").alias("doc_id"), "kept_doc_id", "copies"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


ORACLE_SQL = """
SELECT doc_id, kept_doc_id, copies FROM (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS kept_doc_id, count(*) OVER (PARTITION BY text) AS copies,
    row_number() OVER (PARTITION BY text ORDER BY doc_id NULLS LAST) AS rank
  FROM documents WHERE text IS NOT NULL)
WHERE rank > 1"""
