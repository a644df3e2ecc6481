"""Substring dedup: seed and extend over winnowed anchors.

Seeds are winnowed hashes of ``ANCHOR`` words, dense enough for every passage
of ``min_words`` words to hold one. Anchors that two documents share are joined
back, and around each the passage is extended to both sides in one step for all
its documents: the windows of ``min_words`` words whose least anchor is shared
are keyed by hash, with the word before and the word after. A key of two
documents or more is a repeat, which goes on to a side in a document for as long
as another one goes on with the same word. Where none does, the repeat ends in
that document; between two ends lies a maximal repeat.

So each document has its own maximal repeats: stretches of words of which every
``min_words`` + 1 in a row (or the ``min_words``, if it has no more) stand in
another document, and that no more words can be added to. Of a group of copies
that were each edited apart every document has a few, so work and result grow
with the words, and never with pairs or nested sets of documents. A window
occurs no more often than its least anchor, so the windows of anchors of up to
``HOT`` occurrences meet in one task a key; those of others are aggregated
before they move.

Words are compared by hash: windows by 64 bits, the words beside them by 32.

Defined results: ``doc_id`` is a column of integers. Words are separated by
white space and compare by their bytes. Rows with null doc_id or text take no
part, nor do texts of fewer than ``min_words`` words; texts of any length are
read whole. Rows with one doc_id are one document: repeats within it alone don't
count, equal rows count once, and different texts of it keep their own word
positions. Empty tables give empty results. Columns besides doc_id and text
aren't read, so their names don't matter.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut
from .common import WordHasher, bounded, chunks, mix64, table

MIN_WORDS, ANCHOR = 50, 25
#: Occurrences of an anchor whose windows meet in one task a key.
HOT = 1 << 20
#: Hashes of anchors leave these bits to how often the anchor occurs.
_STATE = np.uint64(3)
_M = np.uint64(0xD6E8FEB86659FD93)
_M_INV = np.uint64(pow(int(_M), -1, 1 << 64))


class _Rolling:
    """Hashes of all runs of a number of words, by prefix sums of a polynomial."""

    def __init__(self) -> None:
        self.pow = self.inv = np.ones(1, np.uint64)

    def __call__(self, words: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
        n = len(words)
        if len(self.pow) < n + 1:
            size = 1 << n.bit_length()
            self.pow = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, _M))])
            self.inv = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, _M_INV))])
        total = np.concatenate([[np.uint64(0)], np.cumsum(words * self.pow[:n], dtype=np.uint64)])
        return [mix64((total[k:] - total[:-k]) * self.inv[: n - k + 1]) if n >= k else np.zeros(0, np.uint64) for k in sizes]


def _words(hasher: WordHasher, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, text of each word, first word of each text and one past the last)."""
    h, start, _ = hasher(raw)
    doc = np.searchsorted(offsets, start, "right") - 1
    return h, doc, np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(offsets) - 1))])


def _slide(x: np.ndarray, width: int, fold) -> np.ndarray:
    """fold over x[i:i+width] for every i, short at the end."""
    out, k = x.copy(), 1
    while k < width:
        step = min(k, width - k)
        if step >= len(out):
            break
        out[: len(out) - step] = fold(out[: len(out) - step], out[step:])
        k += step
    return out


def winnow(grams: np.ndarray, width: int) -> np.ndarray:
    """Whether each hash is the least of some ``width`` hashes in a row."""
    if not len(grams):
        return np.zeros(0, bool)
    least = _slide(grams, width, np.minimum)
    # the largest least value of the windows that cover a place
    cover = _slide(np.concatenate([np.zeros(width - 1, np.uint64), least]), width, np.maximum)[: len(grams)]
    return cover == grams


def _anchors(min_words: int, anchor: int):
    def run(batches):
        import pyarrow as pa

        hasher, rolling = WordHasher(drop_punctuation=False), _Rolling()
        for batch in batches:
            for lo, hi, raw, offsets in chunks(batch):
                words, doc, first = _words(hasher, raw, offsets)
                (grams,) = rolling(words, [anchor])
                if not len(grams):
                    continue
                place = np.arange(len(grams))
                owner = doc[: len(grams)]
                stop = first[owner + 1]
                inside = (place + anchor <= stop) & (stop - first[owner] >= min_words)
                grams = np.where(inside, grams & ~_STATE, np.uint64(0xFFFFFFFFFFFFFFFF))
                hit = np.flatnonzero(winnow(grams, min_words - anchor + 1) & inside)
                ids = batch.column("doc_id").slice(lo, hi - lo).take(pa.array(owner[hit]))
                tag = np.asarray(batch.column("tag").slice(lo, hi - lo))
                yield pa.RecordBatch.from_arrays([pa.array(grams[hit].view(np.int64)), ids, pa.array(hit - first[owner[hit]] + tag[owner[hit]])], ["anchor", "doc_id", "pos"])

    return run


def _windows(min_words: int, anchor: int):
    def run(batches):
        import pyarrow as pa

        hasher, rolling = WordHasher(drop_punctuation=False), _Rolling()
        for batch in batches:
            seeds = batch.column("seeds")
            flat, seed_at = seeds.flatten(), np.concatenate([[0], np.cumsum(np.asarray(seeds.value_lengths()))])
            flat_pos, flat_hot = np.asarray(flat.field("pos")), flat.field("hot").to_numpy(zero_copy_only=False)
            tags = np.asarray(batch.column("tag"))
            for lo, hi, raw, offsets in chunks(batch):
                words, doc, first = _words(hasher, raw, offsets)
                grams, keys = rolling(words, [anchor, min_words])
                if not len(keys):
                    continue
                owner = np.repeat(np.arange(hi - lo), np.diff(seed_at[lo : hi + 1]))
                pos, hot = flat_pos[seed_at[lo] : seed_at[hi]] - tags[lo:hi][owner], flat_hot[seed_at[lo] : seed_at[hi]]
                # seeds of another text of the same document have another tag
                mine = (pos >= 0) & (pos + anchor <= first[owner + 1] - first[owner])
                at = first[owner[mine]] + pos[mine]
                grams &= ~_STATE
                grams[at] |= np.where(hot[mine], np.uint64(2), np.uint64(1))
                # the least anchor of a window is that of all its occurrences, and is a seed if one document more has it
                state = (_slide(grams, min_words - anchor + 1, np.minimum)[: len(keys)] & _STATE).astype(np.int8)
                at = np.flatnonzero((state > 0) & (np.arange(len(keys)) + min_words <= first[doc[: len(keys)] + 1]))
                d = doc[at]
                side = words >> np.uint64(32) | np.uint64(1)  # 0: no word there
                before = np.where(at > first[d], side[at - 1], np.uint64(0))
                after = np.where(at + min_words < first[d + 1], side[np.minimum(at + min_words, len(words) - 1)], np.uint64(0))
                ids = batch.column("doc_id").slice(lo, hi - lo).take(pa.array(d))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[at].view(np.int64)), ids, pa.array(at - first[d] + tags[lo:hi][d]), pa.array((before << np.uint64(32) | after).view(np.int64)), pa.array(state[at] == 2)], ["key", "doc_id", "pos", "sides", "hot"]
                )

    return run


def _alone(group: np.ndarray, word: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether no other document of the group goes on with the same word."""
    order = np.lexsort((doc, word, group))
    g, w, d = group[order], word[order], doc[order]
    first = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (w[1:] != w[:-1])])) if len(g) else np.zeros(0, np.int64)
    if not len(first):
        return np.zeros(0, bool)
    size = np.diff(np.append(first, len(g)))
    one = (d[first] == d[first + size - 1]) | (w[first] == 0)
    out = np.empty(len(g), bool)
    out[order] = np.repeat(one, size)
    return out


def _boundaries(batches):
    """Of windows sorted by key, doc_id and pos: those where a repeat of a document begins, and those where one ends; with the first occurrence of the window."""
    import pyarrow as pa

    def out(key, doc, pos, sides, last):
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        stop = len(key) if last or not len(edge) else int(edge[-1])
        lo = edge[edge < stop]
        size = np.diff(np.append(lo, stop))
        rest = (key[stop:], doc[stop:], pos[stop:], sides[stop:])
        key, doc, pos, sides = key[:stop], doc[:stop], pos[:stop], sides[:stop]
        if not len(lo):
            return rest, None
        before, after = (sides.view(np.uint64) >> np.uint64(32)).view(np.int64), sides & 0xFFFFFFFF
        least, most = (lambda x: np.minimum.reduceat(x, lo)), (lambda x: np.maximum.reduceat(x, lo))
        across = least(doc) != most(doc)
        starts = across & ((least(before) != most(before)) | (least(before) == 0))
        ends = across & ((least(after) != most(after)) | (least(after) == 0))
        use = starts | ends
        if not use.any():
            return rest, None
        group = np.repeat(np.arange(len(lo)), size)
        a, b = np.flatnonzero(np.repeat(starts, size)), np.flatnonzero(np.repeat(ends, size))
        a, b = a[_alone(group[a], before[a], doc[a])], b[_alone(group[b], after[b], doc[b])]
        at = np.concatenate([a, b])
        head = lo[group[at]]
        begins = pa.array(np.concatenate([np.ones(len(a), bool), np.zeros(len(b), bool)]))
        rows = pa.RecordBatch.from_arrays([pa.array(doc[at]), pa.array(pos[at]), begins, pa.array(doc[head]), pa.array(pos[head])], ["doc_id", "pos", "begins", "first_doc", "first_pos"])
        return rest, rows

    rest = tuple(np.zeros(0, np.int64) for _ in range(4))
    for batch in batches:
        rest, rows = out(*[np.concatenate([r, np.asarray(batch.column(i))]) for i, r in enumerate(rest)], False)
        if rows is not None:
            yield rows
    _, rows = out(*rest, True)
    if rows is not None:
        yield rows


def _hot_boundaries(windows: DataFrame) -> DataFrame:
    """The same as ``_boundaries`` by aggregates, which are partly done before rows move."""
    halves = windows.select("key", "doc_id", "pos", F.shiftrightunsigned("sides", 32).alias("before"), F.col("sides").bitwiseAND(F.lit(0xFFFFFFFF)).alias("after"))
    differ = lambda c: (F.min(c) != F.max(c)) | (F.min(c) == 0)
    per = halves.groupBy("key").agg(F.min(F.struct("doc_id", "pos")).alias("head"), (F.min("doc_id") != F.max("doc_id")).alias("across"), differ("before").alias("starts"), differ("after").alias("ends"))
    held = halves.join(per.where("across AND (starts OR ends)"), "key")
    ends = F.filter(F.array(F.struct("starts", F.lit(True).alias("begins"), F.col("before").alias("word")), F.struct(F.col("ends").alias("starts"), F.lit(False).alias("begins"), F.col("after").alias("word"))), lambda e: e["starts"])
    rows = held.select("key", "head", "doc_id", "pos", F.explode(ends).alias("e")).select("key", "head", "doc_id", "pos", "e.begins", "e.word")
    one = rows.groupBy("key", "begins", "word").agg(((F.min("doc_id") == F.max("doc_id")) | (F.col("word") == 0)).alias("alone")).where("alone")
    return rows.join(one, ["key", "begins", "word"]).select("doc_id", "pos", "begins", F.col("head.doc_id").alias("first_doc"), F.col("head.pos").alias("first_pos"))


def maximal_repeats(docs: DataFrame, min_words: int = MIN_WORDS, anchor: int = ANCHOR, hot: int = HOT) -> DataFrame:
    """doc_id, start, n_words, first_doc, first_start: the maximal repeats of ``min_words`` words or more of each document.

    ``start`` is a repeat's first word, from 0. ``first_doc`` and ``first_start``
    name the least place that has its first ``min_words`` words.
    """
    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long"), "text")
    # different texts of one document lie apart in its positions
    twice = cut(texts.groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("a"), F.max(F.xxhash64("text")).alias("b")).where("a <> b").select("doc_id", F.lit(True).alias("many")))
    if twice.isEmpty():
        texts = texts.withColumn("tag", F.lit(0).cast("long"))
    else:
        tag = F.when(F.col("many"), F.shiftleft(F.shiftrightunsigned(F.xxhash64("text"), 34), 32)).otherwise(F.lit(0))
        texts = texts.join(bounded(twice), "doc_id", "left").select("doc_id", "text", tag.cast("long").alias("tag"))
    anchors = texts.mapInArrow(_anchors(min_words, anchor), "anchor long, doc_id long, pos long")
    # counted by partial sums and joined back, so that no task holds an anchor's occurrences as a whole
    counted = cut(anchors.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi").select("anchor", (F.col("n") > hot).alias("hot")))
    seeds = anchors.join(counted, "anchor").groupBy("doc_id").agg(F.collect_set(F.struct("pos", "hot")).alias("seeds"))
    windows = texts.join(seeds, "doc_id").mapInArrow(_windows(min_words, anchor), "key long, doc_id long, pos long, sides long, hot boolean")
    few = windows.where("NOT hot").drop("hot").repartition("key").sortWithinPartitions("key", "doc_id", "pos")
    bounds = few.mapInArrow(_boundaries, "doc_id long, pos long, begins boolean, first_doc long, first_pos long")
    if not counted.where("hot").isEmpty():
        bounds = bounds.unionByName(_hot_boundaries(windows.where("hot")))
    # in a document each beginning is followed by its end; rows that repeat give both twice
    next_ = F.lead("pos").over(Window.partitionBy("doc_id").orderBy("pos", F.desc("begins")))
    word = lambda p: p.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")
    whole = bounds.distinct().withColumn("last", next_).where("begins")
    return whole.select("doc_id", word(F.col("pos")).alias("start"), (F.col("last") - F.col("pos") + min_words).cast("int").alias("n_words"), "first_doc", word(F.col("first_pos")).alias("first_start"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maximal_repeats(table(spark, sf_dir, "documents"))
