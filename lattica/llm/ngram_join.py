"""N-gram Jaccard join: a prefix-tree join of word n-gram sets.

A document's set holds the hashes of its word n-grams (case and punctuation
aside). Documents with one set are one node from here on. Sets are routed to
the tasks that join them by bands of min-hashes; within a band's bucket a
sketch of 32 more hash values tells chance meetings from likely partners, so
that documents which only share a passage aren't chained together. Each
connected group of likely partners then stores its sets, ordered by one global
order of n-grams, in a trie. The trie is traversed once for all sets of the
group: a node holds the overlaps of its prefix with every set, children go on
from their parent's, and a subtree ends where no set's overlap plus what can
remain reaches the threshold. Whether two sets of a group are linked is exact.

Links are counted where they are found, by the documents of either set, so what
leaves a task grows with the sets and not with their pairs. A group of more
sets or n-grams than ``BLOCK_SETS`` and ``BLOCK_GRAMS`` is hashed to blocks, and
each two blocks meet in a task of their own; a bucket of more than
``BUCKET_SETS`` sets is split as well, and the centres of its parts meet again.

The bands miss some links (6 in 100 of those at the threshold 0.5, 2 in 1000 at
0.6), so every other pair that can be a link joins the groups as well, by prefix
and count. All sets follow one order of n-grams, rare ones first. Two linked
sets share n-grams up to where the first of their prefixes ends: at least as
many as a link needs less what follows that prefix. N-grams that occur once are
left out, and sets of one group needn't meet again. An n-gram that occurs often
brings only those together that common n-grams alone could link; other pairs
meet at a rarer one, and are taken to share all common ones. No link is lost by
any of this: the pairs found are more than the links, and the tries decide.

Defined results: ``doc_id`` is a column of integers. Rows with null doc_id and
texts without a word take no part. A text of fewer than n words is one n-gram,
and one of any length is read whole. Rows with one doc_id and one text count
once; rows with one doc_id and different texts are documents each. A Jaccard
value equal to the threshold is a link. Of equal documents the one of least
doc_id (then hash of its text) stays. Empty tables give empty results. Columns
besides doc_id and text aren't read, and the filter returns them unchanged,
whatever their names.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.components import connected_components
from ..functions.lineage import cut
from .common import WordHasher, bounded, chunks, mix64, packed, table, unpacked

N, THRESHOLD = 3, 0.5
BANDS, ROWS, SKETCH = 44, 4, 32
#: Bytes of text hashed at once. A worker's arrays take some 65 times as much, and executors run one a core.
CHUNK = 1 << 19
#: Of the sketch's values, the share of the threshold that likely partners have in common at least: 2.5 deviations under the mean.
SKETCH_LEAST = 0.59
#: A bucket's sets and a block's sets and n-grams in one task; more are split.
BUCKET_SETS, BLOCK_SETS, BLOCK_GRAMS = 1 << 16, 1 << 11, 1 << 22
#: Of the exact candidates: n-grams in a bucket (about), n-grams dealt and pairs counted at once, and the slots of the table of levels (four in a byte).
BUCKET_GRAMS, DEAL_GRAMS, MEET_PAIRS, LEVELS = 1 << 21, 1 << 19, 1 << 20, 1 << 26
#: The power of two of occurrences from which an n-gram is common (2^9): only sets that can be linked by common ones alone meet at it.
COMMON = 9


def gram_sets(hasher: WordHasher, raw: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct n-gram hashes of text after text, sorted within a text; their number per text)."""
    h, start, _ = hasher(raw)
    full = h != 0
    h, start = h[full], start[full]
    count = len(offsets) - 1
    doc = np.searchsorted(offsets, start, "right") - 1
    words = np.bincount(doc, minlength=count)
    first = np.concatenate([[0], np.cumsum(words)[:-1]])
    # short texts give one n-gram of what they have
    grams = np.where(words == 0, 0, np.maximum(words - n + 1, 1))
    owner = np.repeat(np.arange(count), grams)
    begin = np.arange(len(owner)) - np.repeat(np.cumsum(grams) - grams, grams) + first[owner]
    value = np.full(len(owner), 0x51ED270B, np.uint64)
    end = (first + words)[owner]
    for k in range(n):
        pos = begin + k
        more = h[np.minimum(pos, max(len(h) - 1, 0))] if len(h) else np.zeros(len(pos), np.uint64)
        value = np.where(pos < end, mix64(value * np.uint64(0x9E3779B97F4A7C15) + more), value)
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    fresh = np.concatenate([[True], (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])]) if len(owner) else np.zeros(0, bool)
    owner, value = owner[fresh], value[fresh]
    return value, np.bincount(owner, minlength=count)


_RNG = np.random.default_rng(20240607)
_MULT = (_RNG.integers(0, 1 << 31, BANDS * ROWS + SKETCH, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)


def _signatures(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Min-hashes, one row per set (sets begin at ``first``)."""
    x = (value >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(_MULT), len(first)), np.uint32)
    for k, a in enumerate(_MULT):
        y = x * a
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        out[k] = np.minimum.reduceat(y, first)
    return out.T


def _sign(n: int):
    def run(batches):
        import pyarrow as pa

        hasher = WordHasher()
        for batch in batches:
            for lo, hi, raw, offsets in chunks(batch, CHUNK):
                value, size = gram_sets(hasher, raw, offsets, n)
                some = np.flatnonzero(size)
                if not len(some):
                    continue
                first = (np.cumsum(size) - size)[some]
                sig = _signatures(value, first)
                set_id = mix64(np.add.reduceat(mix64(value), first) + size[some].astype(np.uint64)).view(np.int64)
                band = sig[:, : BANDS * ROWS].reshape(len(some), BANDS, ROWS).astype(np.uint64)
                key = np.zeros((len(some), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
                for r in range(ROWS):
                    key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + band[:, :, r])
                sketch = np.ascontiguousarray((sig[:, BANDS * ROWS :] & np.uint32(255)).astype(np.uint8)).view(np.int64)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(0, key.size + 1, BANDS), pa.int32()), pa.array(key.view(np.int64).ravel()))
                part = batch.slice(lo, hi - lo).take(pa.array(some))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("th"), pa.array(set_id), pa.array(size[some].astype(np.int32)), bands, *[pa.array(sketch[:, i].copy()) for i in range(SKETCH // 8)]],
                    ["doc_id", "th", "set_id", "size", "bands", *[f"k{i}" for i in range(SKETCH // 8)]],
                )

    return run


_SKETCH_COLUMNS = [f"k{i}" for i in range(SKETCH // 8)]


def signatures(docs: DataFrame, n: int = N) -> DataFrame:
    """doc_id, th (hash of the text), set_id, size, bands and sketch of every document with a word."""
    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), "text")
    return rows.mapInArrow(_sign(n), "doc_id long, th long, set_id long, size int, bands array<long>, " + ", ".join(f"{k} long" for k in _SKETCH_COLUMNS))


def _likely(threshold: float):
    least = max(1, int(np.floor(SKETCH * SKETCH_LEAST * threshold)))

    def link(ids, sizes, sketch, centres):
        """Edges of one bucket: centres against all, until each is a centre or like one."""
        open_, edges = np.ones(len(ids), bool), []
        while open_.any():
            c = int(open_.argmax())
            like = (sketch == sketch[c]).sum(1) >= least
            like &= (sizes >= threshold * sizes[c]) & (sizes * threshold <= sizes[c])
            like[c] = False
            got = np.flatnonzero(like)
            edges.append((np.full(len(got), ids[c]), ids[got]))
            open_ &= ~like
            open_[c] = False
            centres.append(c)
        return edges

    def run(batches):
        """Of rows sorted by band and part: the edges; of split bands also the centres, as rows with their band."""
        import pyarrow as pa

        def out(rest, last):
            band, part, _, _, _ = rest
            edge = np.flatnonzero(np.concatenate([[True], (band[1:] != band[:-1]) | (part[1:] != part[:-1])])) if len(band) else np.zeros(0, np.int64)
            stop = len(band) if last or not len(edge) else edge[-1]
            cuts = np.append(edge[edge < stop], stop)
            size = np.diff(cuts)
            ids, sizes, sketch = rest[2:]
            whole = part[cuts[:-1]] < 0
            two = cuts[:-1][(size == 2) & whole]
            same = (sketch[two] == sketch[two + 1]).sum(1) >= least
            a, b = sizes[two], sizes[two + 1]
            same &= (a >= threshold * b) & (b >= threshold * a)
            found, middle = [(ids[two[same]], ids[two[same] + 1])], []
            for lo, k, w in zip(cuts[:-1], size, whole):
                if k > 2 or not w:
                    centres = []
                    found += link(ids[lo : lo + k], sizes[lo : lo + k], sketch[lo : lo + k], centres)
                    middle += [] if w else [lo + c for c in centres]
            a, b = (np.concatenate(x) for x in zip(*found))
            pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
            none = np.zeros(len(pair), bool)
            columns = [np.concatenate([pair[:, 0], ids[middle]]), np.concatenate([pair[:, 1], band[middle]]), np.concatenate([none, np.ones(len(middle), bool)])]
            return [x[stop:] for x in rest], pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["a", "b", "centre"])

        rest = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros((0, SKETCH), np.uint8)]
        for batch in batches:
            sketch = np.ascontiguousarray(np.stack([np.asarray(batch.column(k)) for k in _SKETCH_COLUMNS], 1)).view(np.uint8).reshape(-1, SKETCH)
            new = [np.asarray(batch.column("band")), np.asarray(batch.column("part")), np.asarray(batch.column("set_id")), np.asarray(batch.column("size")), sketch]
            rest, edges = out([np.concatenate(x) for x in zip(rest, new)], False)
            if edges.num_rows:
                yield edges
        yield out(rest, True)[1]

    return run


def candidate_edges(sets: DataFrame, threshold: float = THRESHOLD, bucket_sets: int = BUCKET_SETS) -> DataFrame:
    """a, b: likely partners among distinct sets."""
    # bands move with their set's number alone; only what meets gets its sketch
    sketches = sets.select("set_id", "size", *_SKETCH_COLUMNS)
    band = sets.select(F.explode("bands").alias("band"), "set_id")
    # counted by partial sums and joined back, so that no task holds a band as a whole
    many = band.groupBy("band").agg(F.count(F.lit(1)).alias("here")).where("here > 1")
    now, every = band.join(many, "band").join(sketches, "set_id"), None
    while True:
        part = F.when(F.col("here") > bucket_sets, F.pmod(F.xxhash64(F.lit(bucket_sets), "set_id"), F.ceil(F.col("here") / bucket_sets)))
        keyed = now.withColumn("part", F.coalesce(part, F.lit(-1)).cast("long"))
        found = cut(keyed.repartition("band", "part").sortWithinPartitions("band", "part").mapInArrow(_likely(threshold), "a long, b long, centre boolean"))
        edges = found.where("NOT centre").select("a", "b")
        every = edges if every is None else every.unionByName(edges)
        centres = found.where("centre").select(F.col("a").alias("set_id"), F.col("b").alias("band"))
        if centres.isEmpty():
            return every.distinct()
        # the centres of a split bucket's parts meet again, in parts twice as large, so the loop ends
        bucket_sets *= 2
        held = centres.join(sketches, "set_id")
        now = held.join(held.groupBy("band").agg(F.count(F.lit(1)).alias("here")), "band").where("here > 1")


def _by_bucket(value: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order by bucket, 32 bits of every n-gram in that order, where buckets begin)."""
    bucket = (value & np.uint64(buckets - 1)).astype(np.uint16)
    order = np.argsort(bucket, kind="stable")
    return order, (value[order] >> np.uint64(14)).astype(np.uint32), np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=buckets))])


def _tags(n: int, buckets: int):
    """The n-grams of all texts by bucket."""

    def run(batches):
        import pyarrow as pa

        def out(held):
            _, tag, cuts = _by_bucket(np.concatenate(held), buckets)
            rows = [(b, tag[lo:hi].tobytes()) for b, (lo, hi) in enumerate(zip(cuts, cuts[1:])) if lo < hi]
            for lo in range(0, len(rows), 256):
                b, t = zip(*rows[lo : lo + 256])
                yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(t, pa.binary())], ["bucket", "tags"])

        hasher, held, many = WordHasher(), [], 0
        for batch in batches:
            for _, _, raw, offsets in chunks(batch, CHUNK):
                held.append(gram_sets(hasher, raw, offsets, n)[0])
                many += len(held[-1])
                if many >= DEAL_GRAMS:
                    yield from out(held)
                    held, many = [], 0
        if many:
            yield from out(held)

    return run


def _levels(slots: int, often: int):
    """Of one bucket, for every slot, how often the commonest n-gram in it occurs: 0 once, 1 a few times, 2 more, 3 so often that it is common. Four to a byte."""

    def run(t):
        import pyarrow as pa

        tag = np.sort(np.frombuffer(b"".join(t.column("tags").to_pylist()), np.uint32))
        begin = np.flatnonzero(np.concatenate([[True], tag[1:] != tag[:-1]]))
        count = np.diff(np.append(begin, len(tag)))
        many = count > 1
        out = np.zeros(slots, np.uint8)
        power = np.log2(count[many]).astype(np.uint8)
        np.maximum.at(out, _slot(tag[begin[many]], slots), 1 + (2 * power > often).astype(np.uint8) + (power >= often))
        four = np.bitwise_or.reduce(out.reshape(-1, 4) << np.arange(0, 8, 2, dtype=np.uint8), axis=1)
        return pa.table({"bucket": t.column("bucket").slice(0, 1).cast(pa.int32()), "levels": pa.array([four.tobytes()], pa.binary())})

    return run


def _slot(tag: np.ndarray, slots: int) -> np.ndarray:
    return (tag.astype(np.int64) * slots) >> 32


def _level(levels: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The levels of n-grams, from a table of ``gram_levels``."""
    buckets, slots = levels.shape[0], levels.shape[1] * 4
    at = (value & np.uint64(buckets - 1)).astype(np.int64) * slots + _slot((value >> np.uint64(14)).astype(np.uint32), slots)
    return (levels.ravel()[at >> 2] >> ((at & 3) << 1).astype(np.uint8)) & np.uint8(3)


def gram_levels(texts: DataFrame, n: int, buckets: int, slots: int, often: int = COMMON) -> np.ndarray:
    """A table of ``buckets`` x ``slots`` levels of commonness, four to a byte. The order made from it bears on work; results are the same under any."""
    levels = np.zeros((buckets, slots // 4), np.uint8)
    rows = texts.mapInArrow(_tags(n, buckets), "bucket int, tags binary").groupBy("bucket").applyInArrow(_levels(slots, often), "bucket int, levels binary").toArrow()
    for b, blob in zip(rows.column("bucket").to_pylist(), rows.column("levels").to_pylist()):
        levels[b] = np.frombuffer(blob, np.uint8)
    return levels


def _prefixes(n: int, threshold: float, shared):
    """Of every text the n-grams in its prefix that occur elsewhere too: rare ones stand first in the global order. Linked sets have one in common at least."""

    def run(batches):
        import pyarrow as pa

        levels, hasher = shared.value, WordHasher()
        for batch in batches:
            for _, _, raw, offsets in chunks(batch, CHUNK):
                value, size = gram_sets(hasher, raw, offsets, n)
                some = np.flatnonzero(size)
                if not len(some):
                    continue
                size = size[some]
                first = np.cumsum(size) - size
                set_id = mix64(np.add.reduceat(mix64(value), first) + size.astype(np.uint64)).view(np.int64)
                level = _level(levels, value)
                # by level, then by hash, as which they come
                order = np.argsort(np.repeat(np.arange(len(size), dtype=np.int32) * 4, size) + level, kind="stable")
                value, level = value[order], level[order]
                length = size - np.ceil(threshold * size - 1e-9).astype(np.int64) + 1
                end = first + length - 1
                last = ((level[end].astype(np.uint64) << np.uint64(56)) | (value[end] >> np.uint64(8))).view(np.int64)
                # an n-gram of level 0 occurs nowhere else; these come first
                single = np.minimum(np.add.reduceat((level == 0).astype(np.int64), first), length)
                common = np.maximum(length - np.add.reduceat((level < 3).astype(np.int64), first), 0)
                open_ = np.flatnonzero(single < length)
                blobs = [value[a:b].tobytes() for a, b in zip((first + single)[open_], (first + length)[open_])]
                yield pa.RecordBatch.from_arrays([pa.array(set_id[open_]), pa.array(size[open_].astype(np.int32)), pa.array(last[open_]), pa.array(common[open_].astype(np.int32)), pa.array(blobs, pa.binary())], ["set_id", "size", "last", "common", "prefix"])

    return run


_HEAD = np.dtype([("set_id", "<i8"), ("component", "<i8"), ("last", "<i8"), ("size", "<i4"), ("common", "<i4"), ("count", "<i4")])


def _deal(buckets: int):
    """The prefixes' n-grams by bucket: heads of the sets, and 32 bits of every n-gram."""

    def run(batches):
        import pyarrow as pa

        def out(held):
            head = np.concatenate([h for h, _ in held])
            value = np.concatenate([v for _, v in held])
            owner = np.repeat(np.arange(len(head)), head["count"])
            order, tag, cuts = _by_bucket(value, buckets)
            # the lowest bit tells common n-grams, which end a prefix
            place = np.arange(len(owner)) - np.repeat(np.cumsum(head["count"]) - head["count"], head["count"])
            tag = (tag & ~np.uint32(1)) | (place >= (head["count"] - head["common"])[owner])[order].astype(np.uint32)
            owner = owner[order]
            rows = []
            for b in range(buckets):
                lo, hi = cuts[b], cuts[b + 1]
                if lo < hi:
                    mine, count = np.unique(owner[lo:hi], return_counts=True)
                    part = head[mine]
                    part["count"] = count
                    rows.append((b, part.tobytes(), tag[lo:hi].tobytes()))
            for lo in range(0, len(rows), 256):
                b, h, t = zip(*rows[lo : lo + 256])
                yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(h, pa.binary()), pa.array(t, pa.binary())], ["bucket", "heads", "tags"])

        held, many = [], 0
        for batch in batches:
            blobs = batch.column("prefix").to_pylist()
            if not blobs:
                continue
            head = np.zeros(len(blobs), _HEAD)
            for k in ("set_id", "component", "last", "size", "common"):
                head[k] = np.asarray(batch.column(k))
            head["count"] = [len(b) // 8 for b in blobs]
            value = np.frombuffer(b"".join(blobs), np.uint64)
            held.append((head, value))
            many += len(value)
            if many >= DEAL_GRAMS:
                yield from out(held)
                held, many = [], 0
        if held:
            yield from out(held)

    return run


def _meet(threshold: float, at_once: int):
    """Of rows sorted by bucket: pairs of sets of two components that share n-grams there, how many, and how many they must share in all."""

    def rest(size):
        """What follows a prefix: all that two sets can share besides the n-grams up to the end of the prefix that ends first."""
        return np.ceil(threshold * size - 1e-9).astype(np.int64) - 1

    def least(a, b):
        return np.ceil((threshold * (a + b) - 1e-9) / (1 + threshold)).astype(np.int64)

    def alike(a, b):
        return (a >= threshold * b - 1e-9) & (b >= threshold * a - 1e-9)

    def meet(heads, tags):
        import pyarrow as pa

        head, tag = np.frombuffer(b"".join(heads), _HEAD), np.frombuffer(b"".join(tags), np.uint32)
        # copies of a set have the same n-grams here: the first stands for all
        _, at, same = np.unique(head["set_id"], return_index=True, return_inverse=True)
        stays = np.repeat(at[same] == np.arange(len(head)), head["count"])
        owner, tag = np.repeat(same, head["count"])[stays], tag[stays]
        head = head[at]
        ids, last, size, common = head["set_id"], head["last"], head["size"].astype(np.int64), head["common"].astype(np.int64)
        component = np.unique(head["component"], return_inverse=True)[1]
        order = np.argsort(tag, kind="stable")
        owner, tag = owner[order], tag[order]
        cuts = np.flatnonzero(np.concatenate([[True], tag[1:] != tag[:-1]]))
        length, mine = np.diff(np.append(cuts, len(tag))), component[owner]
        mixed = (length > 1) & (np.maximum.reduceat(mine, cuts) != np.minimum.reduceat(mine, cuts))
        cuts, length = cuts[mixed], length[mixed]
        many = (tag[cuts] & 1).astype(bool)

        def needed(a, b):
            besides = np.where(last[a] < last[b], rest(size[a]), np.where(last[a] > last[b], rest(size[b]), rest(np.maximum(size[a], size[b]))))
            return least(size[a], size[b]) - besides

        def rare_pairs():
            for k in np.unique(length[~many]):
                begin = cuts[(length == k) & ~many]
                i, j = np.triu_indices(int(k), 1)
                step = max(1, at_once // len(i))
                for lo in range(0, len(begin), step):
                    here = owner[begin[lo : lo + step, None] + np.arange(k)]
                    a, b = here[:, i].ravel(), here[:, j].ravel()
                    fits = (component[a] != component[b]) & alike(size[a], size[b])
                    yield a[fits], b[fits]

        def common_pairs():
            # sets of one size and number of common n-grams are told at once that they can't be linked by these alone
            base = int(common.max(initial=0)) + 1
            for lo, k in zip(cuts[many], length[many]):
                here = owner[lo : lo + k]
                kinds, kind = np.unique(size[here] * base + common[here], return_inverse=True)
                by = np.argsort(kind, kind="stable")
                here, kind = here[by], kind[by]
                n, c = np.divmod(kinds, base)
                begin = np.searchsorted(kind, np.arange(len(kinds) + 1))
                for q in range(len(kinds)):
                    fits = alike(n[q], n[q:]) & (least(n[q], n[q:]) - rest(np.maximum(n[q], n[q:])) <= np.minimum(c[q], c[q:]))
                    if not fits.any():
                        continue
                    others = here[begin[q] :][fits[kind[begin[q] :] - q]]
                    for x in range(begin[q + 1] - begin[q]):
                        a, b = here[begin[q] + x], others[x + 1 :] if fits[0] else others
                        b = b[component[b] != component[a]]
                        a = np.full(len(b), a)
                        fit = needed(a, b) <= np.minimum(common[a], common[b])
                        yield a[fit], b[fit]

        held, waiting = [], 0

        def out():
            code, shared = np.unique(np.concatenate(held), return_counts=True)
            a, b = np.divmod(code, len(head))
            need, both = needed(a, b), np.minimum(common[a], common[b])
            # pairs that didn't meet at common n-grams may share all of them
            need = np.where(need > both, need - both, need)
            return pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b]), pa.array(shared), pa.array(need)], ["a", "b", "shared", "least"])

        for a, b in itertools.chain(rare_pairs(), common_pairs()):
            if len(a):
                held.append(np.minimum(a, b) * len(head) + np.maximum(a, b))
                waiting += len(a)
            if waiting >= at_once:
                yield out()
                held, waiting = [], 0
        if held:
            yield out()

    def run(batches):
        now, heads, tags = None, [], []
        for batch in batches:
            for bucket, h, t in zip(*(batch.column(k).to_pylist() for k in ("bucket", "heads", "tags"))):
                if bucket != now and heads:
                    yield from meet(heads, tags)
                    heads, tags = [], []
                now = bucket
                heads.append(h)
                tags.append(t)
        if heads:
            yield from meet(heads, tags)

    return run


def missed_edges(docs: DataFrame, sets: DataFrame, groups: DataFrame, n: int = N, threshold: float = THRESHOLD, bucket_grams: int = BUCKET_GRAMS, often: int = COMMON, at_once: int = MEET_PAIRS) -> DataFrame:
    """a, b: pairs of sets of different ``groups``, all those that can reach the threshold among them (by prefix and count, exact)."""
    told = sets.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("grams")).first()
    grams = told["grams"] or 0
    buckets = min(1 << 14, 1 << (grams // bucket_grams).bit_length())
    slots = min(LEVELS // buckets, max(4, 1 << (4 * grams // buckets).bit_length()))
    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("text")
    shared = docs.sparkSession.sparkContext.broadcast(gram_levels(texts, n, buckets, slots, often))
    prefixes = texts.mapInArrow(_prefixes(n, threshold, shared), "set_id long, size int, last long, common int, prefix binary")
    # by shuffle, so that no executor runs the Python of both sides of the join at once
    placed = prefixes.join(groups.withColumnRenamed("node", "set_id").hint("merge"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    dealt = placed.mapInArrow(_deal(max(1, buckets // 2)), "bucket int, heads binary, tags binary")
    met = dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_meet(threshold, at_once), "a long, b long, shared long, least long")
    return cut(met.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.first("least").alias("least")).where("shared >= least").select("a", "b"))


def traverse(sets: list[np.ndarray], threshold: float, visit) -> None:
    """``visit(i, others, overlaps)`` once for each n-gram set, with all sets (also itself) of Jaccard ``threshold`` or more."""
    m = len(sets)
    if m < 2:
        return
    size = np.array([len(s) for s in sets])
    every = np.concatenate(sets)
    grams, gram, df = np.unique(every, return_inverse=True, return_counts=True)
    # the global order: common n-grams first, so that sets share long prefixes
    rank_of = np.empty(len(grams), np.int64)
    rank_of[np.lexsort((grams, -df))] = np.arange(len(grams))
    ranked, owner = rank_of[gram], np.repeat(np.arange(m), size)
    order = np.lexsort((owner, ranked))
    holders, begin = owner[order], np.concatenate([[0], np.cumsum(np.bincount(ranked, minlength=len(grams)))])
    edge = np.concatenate([[0], np.cumsum(size)])
    path = [np.sort(ranked[edge[i] : edge[i + 1]]) for i in range(m)]
    row = sorted(range(m), key=lambda i: path[i].astype(">i4").tobytes())
    path = [path[i] for i in row]
    length = size[row]
    lcp = np.zeros(m, np.int64)
    for i in range(1, m):
        k = min(length[i - 1], length[i])
        diff = np.flatnonzero(path[i - 1][:k] != path[i][:k])
        lcp[i] = diff[0] if len(diff) else k
    stack = [(0, m, 0, np.zeros(m, np.int64))]
    while stack:
        lo, hi, depth, overlap = stack.pop()
        upto = int(lcp[lo + 1 : hi].min()) if hi - lo > 1 else int(length[lo])
        if upto > depth:
            part = path[lo][depth:upto]
            # ranks that stand side by side have their holders side by side
            jump = np.flatnonzero(np.diff(part) != 1) + 1
            starts, ends = part[np.concatenate([[0], jump])], part[np.concatenate([jump - 1, [len(part) - 1]])]
            met = np.concatenate([holders[begin[a] : begin[b + 1]] for a, b in zip(starts, ends)])
            overlap = overlap + np.bincount(met, minlength=m)
        short, long = int(length[lo:hi].min()), int(length[lo:hi].max())
        reach = overlap + np.minimum(long - upto, size - overlap)
        alive = (reach * (1 + threshold) >= threshold * (size + short) - 1e-9) & (size >= threshold * short - 1e-9) & (size * threshold <= long + 1e-9)
        alive[row[lo]] &= hi - lo > 1
        if not alive.any():
            continue
        ended = lo
        while ended < hi and length[ended] == upto:
            s = row[ended]
            fits = np.flatnonzero(overlap >= threshold * (size + size[s] - overlap) - 1e-9)
            visit(s, fits, overlap[fits])
            ended += 1
        if ended < hi:
            cuts = [ended, *(i for i in range(ended + 1, hi) if lcp[i] == upto), hi]
            stack += [(a, b, upto, overlap) for a, b in zip(cuts, cuts[1:])]


def trie_join(sets: list[np.ndarray], threshold: float) -> list[tuple[int, int, int]]:
    """(i, j, overlap), i < j, of all pairs of n-gram sets with Jaccard of ``threshold`` or more."""
    out: list[tuple[int, int, int]] = []
    traverse(sets, threshold, lambda s, fits, overlaps: out.extend((int(r), int(s), int(o)) for r, o in zip(fits, overlaps) if r < s))
    return out


def _join_group(threshold: float):
    def run(t):
        """Of the sets of one block, or of two: the documents that each is linked to, and the least set that it is connected to here."""
        import pyarrow as pa

        ids, at = np.unique(np.asarray(t.column("set_id")), return_index=True)
        blobs, docs = t.column("grams").to_pylist(), np.asarray(t.column("docs"))[at]
        across = t.column("x")[0].as_py() != t.column("y")[0].as_py()
        block = np.asarray(t.column("block"))[at]
        links, label = np.zeros(len(ids), np.int64), np.arange(len(ids))

        def visit(s, fits, overlaps):
            fits = fits[block[fits] != block[s]] if across else fits[fits != s]
            if len(fits):
                links[s] += docs[fits].sum()
                mine = np.unique(np.append(label[fits], label[s]))
                if len(mine) > 1:
                    label[np.isin(label, mine)] = mine[0]

        traverse([np.frombuffer(blobs[i], np.uint64) for i in at], threshold, visit)
        some = np.flatnonzero(links)
        return pa.table({"set_id": pa.array(ids[some]), "links": pa.array(links[some]), "grp": pa.array(ids[label[some]])})

    return run


def _grams(n: int):
    def run(batches):
        import pyarrow as pa

        hasher = WordHasher()
        for batch in batches:
            for _, _, raw, offsets in chunks(batch, CHUNK):
                value, size = gram_sets(hasher, raw, offsets, n)
                some = np.flatnonzero(size)
                if not len(some):
                    continue
                first = (np.cumsum(size) - size)[some]
                set_id = mix64(np.add.reduceat(mix64(value), first) + size[some].astype(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(set_id), pa.array([value[a : a + k].tobytes() for a, k in zip(first, size[some])], pa.binary())], ["set_id", "grams"])

    return run


def linked_sets(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, block_sets: int = BLOCK_SETS, block_grams: int = BLOCK_GRAMS, bucket_sets: int = BUCKET_SETS) -> tuple[DataFrame, DataFrame]:
    """(members: doc_id, th, set_id, one row a document; links: set_id, links, grp of the sets linked to others).

    ``links`` counts the documents of other sets that a set is linked to, ``grp`` names its connected class.
    """
    signed = cut(signatures(docs, n))
    members = signed.select("doc_id", "th", "set_id").distinct()
    sets = signed.drop("doc_id", "th").dropDuplicates(["set_id"])
    likely = cut(connected_components(candidate_edges(sets, threshold, bucket_sets)))
    # the bands miss some: whatever else can reach the threshold joins the groups
    missed = missed_edges(docs, sets, likely, n, threshold)
    groups = connected_components(likely.select(F.col("node").alias("a"), F.col("component").alias("b")).union(missed))
    # one document stands for each set that has likely partners
    held = members.groupBy("set_id").agg(F.min(F.struct("doc_id", "th")).alias("d"), F.count(F.lit(1)).alias("docs"))
    known = cut(groups.withColumnRenamed("node", "set_id").join(held, "set_id").join(sets.select("set_id", "size"), "set_id"))
    wanted = bounded(known.select("d.*"))
    texts = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), "text").join(wanted, ["doc_id", "th"], "left_semi").select("text")
    # blocks of a group by hash, and a task for each two of them
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / block_sets, F.sum("size") / block_grams)).cast("int")
    split = known.groupBy("component").agg(blocks.alias("blocks"))
    placed = known.select("set_id", "component", "docs").join(split, "component").withColumn("block", F.pmod(F.xxhash64(F.lit(0), "set_id"), F.col("blocks")).cast("int"))
    sides = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keyed = sides.select("set_id", "component", "docs", "blocks", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))
    # rows that repeat a document give its set again, which a task takes once
    grams = texts.mapInArrow(_grams(n), "set_id long, grams binary")
    joined = cut(grams.join(keyed, "set_id").groupBy("component", "x", "y").applyInArrow(_join_group(threshold), "set_id long, links long, grp long"))
    once = joined.groupBy("set_id").agg(F.sum("links").alias("links"), F.min("grp").alias("grp"), F.max("grp").alias("last"))
    if split.where("blocks > 1").isEmpty():
        return members, once.drop("last")
    # what two tasks say of a set belongs together
    classes = connected_components(joined.select(F.col("set_id").alias("a"), F.col("grp").alias("b")))
    return members, once.drop("grp", "last").join(classes.select(F.col("node").alias("set_id"), F.col("component").alias("grp")), "set_id")


def near_documents(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, **sizes) -> DataFrame:
    """doc_id, class_id, n_links: one row for each document with a link to another (a Jaccard value of ``threshold`` or more).

    ``class_id`` is the least doc_id of those connected by links, ``n_links``
    the number of documents that it is linked to, copies included.
    """
    members, links = linked_sets(docs, n, threshold, **sizes)
    copies = members.groupBy("set_id").agg(F.count(F.lit(1)).alias("docs"), F.min("doc_id").alias("least"))
    known = copies.join(links, "set_id", "left").withColumn("grp", F.coalesce("grp", "set_id"))
    linked = known.where("docs > 1 OR links > 0").select("set_id", "least", "grp", (F.coalesce("links", F.lit(0)) + F.col("docs") - 1).alias("n_links"))
    classes = linked.groupBy("grp").agg(F.min("least").alias("class_id"))
    return members.join(linked.join(classes, "grp"), "set_id").select("doc_id", "class_id", "n_links")


def drop_near_copies(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, **sizes) -> DataFrame:
    """The input's rows and columns, with the least doc_id of each group of near copies and all rows without partner."""
    members, links = linked_sets(docs, n, threshold, **sizes)
    sets = members.groupBy("set_id").agg(F.count(F.lit(1)).alias("docs"), F.min(F.struct("doc_id", "th")).alias("best"))
    known = sets.join(links, "set_id", "left").select("set_id", "docs", "best", F.coalesce("grp", "set_id").alias("grp"))
    classes = known.groupBy("grp").agg(F.min("best").alias("best"), F.sum("docs").alias("of")).where("of > 1")
    owned = members.join(known.select("set_id", "grp").join(classes, "grp"), "set_id")
    gone = owned.where((F.col("doc_id") != F.col("best.doc_id")) | (F.col("th") != F.col("best.th"))).select(F.col("doc_id").alias("__lt_id"), F.col("th").alias("__lt_th"))
    rows = packed(docs, __lt_i=F.col("doc_id").cast("long"), __lt_t=F.xxhash64("text"))
    left = rows.join(bounded(cut(gone)), (F.col("__lt_i") == F.col("__lt_id")) & (F.col("__lt_t") == F.col("__lt_th")), "left_anti")
    again = cut(docs.where("doc_id IS NOT NULL AND text IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("__lt_id"), F.xxhash64("text").alias("__lt_th")).agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    if again.isEmpty():
        return unpacked(left)
    # rows that repeat both doc_id and text are copies too: the first met stays
    twice = (F.col("__lt_i") == F.col("__lt_id")) & (F.col("__lt_t") == F.col("__lt_th"))
    few = bounded(again.drop("n"))
    single = left.join(few, twice, "left_anti").select("__lt_row")
    return unpacked(single.unionByName(left.join(few, twice).groupBy("__lt_i", "__lt_t").agg(F.first("__lt_row").alias("__lt_row")).select("__lt_row")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_documents(table(spark, sf_dir, "documents"))
