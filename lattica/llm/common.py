"""What the corpus operators share: table reading, row packing, word hashing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that Java's, RE2's and our own splitters agree on.
WS = r"[ \t\r\n\f\x0B]+"
#: The caller's row while an operator adds columns of its own beside it.
ROW = "__lt_row"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(df: DataFrame, **extra: Column) -> DataFrame:
    """One struct column with the caller's row, then the operator's own columns.

    Columns of the caller can so have any name, also that of an operator's column.
    """
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(ROW), *[c.alias(k) for k, c in extra.items()])


def unpacked(df: DataFrame) -> DataFrame:
    return df.select(f"{ROW}.*")


#: Tables of narrow rows are broadcast up to this many; larger ones meet the texts by shuffle.
BROADCAST_KEYS = 1_000_000


def bounded(keys: DataFrame, most: int | None = None) -> DataFrame:
    """``keys`` with a broadcast hint if it has at most ``most`` rows (it is counted, so give one that is cut)."""
    return F.broadcast(keys) if keys.count() <= (BROADCAST_KEYS if most is None else most) else keys


def words_of(text: Column) -> Column:
    """Number of white-space separated words; 0 for null and blank texts."""
    bare = F.regexp_replace(text, "^" + WS, "")
    return F.when(text.isNull() | (bare == ""), 0).otherwise(F.size(F.split(F.regexp_replace(bare, WS + "$", ""), WS)))


def tokens_of(text: Column) -> Column:
    """Number of tokens: runs of letters and digits, and every other character that isn't white space."""
    runs = F.regexp_replace(text, r"[\p{L}\p{N}]+", "a")
    return F.coalesce(F.length(F.regexp_replace(runs, WS, "")), F.lit(0)).cast("int")


#: The same count for DuckDB.
TOKENS_SQL = r"coalesce(length(regexp_replace(regexp_replace(text, '[\p{L}\p{N}]+', 'a', 'g'), '[ \t\r\n\f\x0B]+', '', 'g')), 0)::INT"

_MUL = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_MUL), -1, 1 << 64))


def mix64(x: np.ndarray) -> np.ndarray:
    """Splitmix64's finaliser: a bijection of 64-bit words."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordHasher:
    """64-bit hashes of the words of a batch of texts, without a Python loop over words.

    A word is a maximal run of bytes that ``fold`` doesn't map to 0. Its hash is
    the polynomial of its folded bytes, from prefix sums, so equal words have
    equal hashes wherever they stand.
    """

    def __init__(self, drop_punctuation: bool = True) -> None:
        fold = np.arange(256, dtype=np.uint64)
        fold[[9, 10, 11, 12, 13, 32]] = 0
        skip = np.zeros(256, bool)
        if drop_punctuation:
            for c in range(33, 127):
                if not chr(c).isalnum():
                    skip[c] = True
            fold[65:91] += 32
        self.fold, self.skip = fold, skip
        self.pow = np.ones(1, np.uint64)
        self.inv = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.pow) < n:
            size = 1 << (n - 1).bit_length()
            self.pow = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, _MUL))])
            self.inv = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, _INV))])

    def __call__(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hashes, start byte, end byte) of the words in the UTF-8 bytes ``raw``."""
        if not len(raw):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        value = self.fold[raw]
        gap = value == 0
        keep = ~self.skip[raw]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8)))
        start, end = edge[0::2], edge[1::2]
        # skipped bytes take no place, so "word," and "word" hash alike
        place = np.cumsum(keep) - 1
        self._powers(len(raw) + 1)
        term = np.where(keep & ~gap, value * self.pow[np.maximum(place, 0)], np.uint64(0))
        total = np.concatenate([[np.uint64(0)], np.cumsum(term, dtype=np.uint64)])
        first = np.where(keep[start], place[start], place[start] + 1)
        h = (total[end] - total[start]) * self.inv[first]
        return mix64(h), start, end


def text_batches(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; nulls are empty texts."""
    import pyarrow as pa

    column = column.fill_null("") if column.null_count else column
    if column.type != pa.large_string():
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return raw, off - off[0] if len(off) else np.zeros(1, np.int64)


def chunks(batch, size: int = 1 << 21):
    """(first row, last row, bytes, offsets) of slices of a batch's ``text``, each text ended by a line feed."""
    import pyarrow as pa
    import pyarrow.compute as pc

    text = pc.fill_null(batch.column("text"), "").cast(pa.large_string())
    lengths = np.asarray(pc.binary_length(text)) + 1
    at = np.concatenate([[0], np.cumsum(lengths)])
    lo = 0
    while lo < len(lengths):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + size, "right")) - 1)
        part = pc.binary_join_element_wise(text.slice(lo, hi - lo), *(pa.scalar(x, pa.large_string()) for x in ("", "\n")))
        yield (lo, hi, *text_batches(part))
        lo = hi
