"""Packing: shortest-pack-first over the length histogram.

Documents longer than a pack are cut into full pieces and a remainder. The
histogram of piece lengths, of at most ``capacity`` entries, is packed on the
driver: lengths go longest first into the shortest open pattern, and a
pattern's count is split when only part of its packs are met. Pieces are then
ranked within their length and joined to the slots of the patterns by rank.

Texts are read once, for their lengths, which are kept in the shared folder.
Ranks are offsets of hash buckets plus a rank within the bucket, so no task
sorts all pieces of one length; there are as many buckets as keep each near
``BUCKET`` pieces.

Defined results: ``doc_id`` may be of any type that has an order. A document
without tokens (null, empty or blank text) gets one row with a null pack. A very
long text is as many pieces as it needs. Rows that repeat a doc_id are packed
each; pieces of one length, doc_id and place are interchangeable. An empty table
gives an empty result. Columns other than doc_id and text aren't read, so their
names don't matter.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut
from .common import table, tokens_of

CAPACITY, BUCKETS, BUCKET = 2048, 256, 1 << 18
#: Slot tables of up to this many rows are broadcast.
BROADCAST_SLOTS = 1 << 20


def pack_histogram(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(number of packs, {length: how many of it in such a pack}) per pattern.

    The shortest pattern that a length fits is the one with most room.
    """
    room: dict[int, list[list]] = defaultdict(list)  # free space: [[packs, {length: multiplicity}]]
    widest = 0
    for length in sorted((x for x in counts if counts[x] > 0), reverse=True):
        n = counts[length]
        while n > 0:
            while widest > 0 and not room[widest]:
                widest -= 1
            if widest < length:
                # all lengths so far are no shorter than this one, so as many as fit go together
                each = min(capacity // length, n)
                packs = n // each
                room[capacity - each * length].append([packs, {length: each}])
                widest = max(widest, capacity - each * length)
                n -= packs * each
                continue
            packs, held = room[widest].pop()
            used = min(packs, n)
            if packs > used:
                room[widest].append([packs - used, held])
            room[widest - length].append([used, {**held, length: held.get(length, 0) + 1}])
            n -= used
    return [(packs, held) for free in sorted(room) for packs, held in room[free]]


def pieces(sized: DataFrame, capacity: int) -> DataFrame:
    """doc_id, piece, start, length of rows of doc_id and n tokens: what fits a pack each; one piece of length 0 for a document without tokens."""
    apart = sized.select("doc_id", "n", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / capacity).cast("int") - 1, F.lit(0)))).alias("piece"))
    start = F.col("piece") * capacity
    return apart.select("doc_id", "piece", start.alias("start"), F.least(F.col("n") - start, F.lit(capacity)).alias("length"))


def pack(docs: DataFrame, capacity: int = CAPACITY, buckets: int | None = None) -> DataFrame:
    """pack_id, pack_offset, doc_id, piece, start, length: the place of every piece, in tokens."""
    spark = docs.sparkSession
    sized = cut(docs.select("doc_id", tokens_of(F.col("text")).alias("n")))
    if buckets is None:
        buckets = max(BUCKETS, -(-sized.count() // BUCKET))
    every = pieces(sized, capacity).withColumn("b", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    some = every.where("length > 0")
    counted = some.groupBy("length", "b").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    slots, taken, base = [], defaultdict(int), 0
    for packs, held in pack_histogram(histogram, capacity):
        offset = 0
        for length, many in held.items():
            slots.append((length, taken[length], taken[length] + packs * many, many, base, offset))
            taken[length] += packs * many
            offset += length * many
        base += packs
    slot = spark.createDataFrame(slots, "length int, lo long, hi long, many int, base long, at int")
    if len(slots) <= BROADCAST_SLOTS:
        slot = F.broadcast(slot)
    # rank of a piece among those of its length: its bucket's offset, then its place in the bucket
    offsets = counted.select("length", "b", (F.sum("n").over(Window.partitionBy("length").orderBy("b")) - F.col("n")).alias("before"))
    local = F.row_number().over(Window.partitionBy("length", "b").orderBy(F.col("doc_id"), F.col("piece"))) - 1
    ranked = some.withColumn("local", local).join(offsets, ["length", "b"]).withColumn("rank", F.col("before") + F.col("local"))
    placed = ranked.join(slot, "length").where("rank >= lo AND rank < hi")
    inner = F.col("rank") - F.col("lo")
    rows = placed.select(
        (F.col("base") + F.expr("(rank - lo) div many")).alias("pack_id"),
        (F.col("at") + F.col("length") * (inner % F.col("many"))).cast("int").alias("pack_offset"),
        "doc_id", "piece", "start", "length",
    )
    none = every.where("length = 0").select(F.lit(None).cast("long").alias("pack_id"), F.lit(None).cast("int").alias("pack_offset"), "doc_id", "piece", "start", "length")
    return rows.unionByName(none)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
