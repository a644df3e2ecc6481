"""Secret scans: novelty of candidates under a dictionary-primed zstandard.

A candidate is a run of ``MIN_CHARS`` or more printable ASCII characters without
white space, quotes, brackets, commas and semicolons; a name with ``=`` or ``:``
at its front belongs to what stands before it. Its context is sensitive where it
is the first candidate after a sensitive name (token, password, api key ...) on
a line, at any distance, with no end of a sentence between, or goes on the list
that the first one begins, or lies in the body of a private key block. Its novelty is the number of bytes that it adds to the compressed size of
the text around it, over its length; the compressor is primed with a dictionary
of the identifiers that recur in the corpus and of names common in code.
Placeholders, words, paths and repeated patterns compress away; what stays
incompressible is reported: with a novelty of ``NOVELTY``, or ``WORDY_NOVELTY``
where a candidate has no digit.

Identifiers are runs of letters, ``_`` and ``-``, counted over all documents.
Those of under ``IDENTIFIER`` letters are no help to the compressor, whose
shortest match is as long. A dictionary's size is a parameter, as the
compressor's window is: ``AROUND`` bytes to either side, within the text.

Defined results: ``doc_id`` is a column of integers. Null and empty texts report
nothing; a document reports every occurrence, in any number and at any length of
the text; rows that repeat a doc_id report each, and equal texts report alike. A
tie with the threshold is reported. Offsets count characters from 0. Results
don't depend on how rows are partitioned. Columns besides doc_id and text aren't
read, so their names don't matter.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import cut
from .common import WordHasher, chunks, table

MIN_CHARS, NOVELTY, WORDY_NOVELTY, DICTIONARY, MIN_DOCS = 16, 0.45, 0.65, 1 << 15, 5
AROUND, IDENTIFIER = 2048, 4
_NAMES = (
    "public private protected static function return import export const string number boolean null undefined true false "
    "api_key apikey access_token auth_token client_secret secret_key private_key password passwd username authorization bearer "
    "example placeholder your_api_key_here changeme dummy sample test config settings environment process.env os.environ "
    "http https localhost example.com 0123456789 1234567890123456 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ xxxxxxxxxxxxxxxx 0000000000000000"
)
#: Names that are sensitive by themselves, within any longer word or as a part of one, and the one that needs company.
_ALONE, _WITHIN, _KEY = (b"token", b"secret", b"pwd", b"credential", b"bearer", b"authorization", b"signature"), (b"password", b"passwd", b"passphrase"), b"key"
#: A part of a word begins after what isn't a letter, at a capital, or after one of these.
_BEFORE = re.compile(rb"(?:^|[^A-Za-z]|(?i:api|access|auth|client|session|refresh|bot|user|db|app))\Z")
#: It doesn't go on as in tokenizer or TOKENIZER.
_AFTER = re.compile(rb"(?:(?<=[A-Z])S|s)?(?![a-z])(?!(?<=[A-Z])[A-Z])")
_COMPANY = re.compile(rb"(?i:api|access|secret|private|auth|client|account|session|master|service|signing|encryption|ssh)[_\-. ]?\Z")
_VALUED = re.compile(rb"s?[\"'`\])]*[ \t]*(?:=>|[:=])")
_APART = re.compile(rb"[ \t\"'`,;()\[\]{}<>]*")
_BLOCK = re.compile(rb"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----")
_PREFIX = re.compile(rb"(?:[A-Za-z_$][\w.$-]*+(?:=>|:=|[:=])++)+")


def _runs(raw: np.ndarray, inside: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of the runs of at least ``least`` bytes of a class."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside[raw], [False]]).astype(np.int8)))
    a, b = edge[0::2], edge[1::2]
    long = b - a >= least
    return a[long], b[long]


def _class(pattern: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[c for c in range(256) if re.match(pattern, bytes([c]))]] = True
    return out


_CANDIDATE, _LETTERS = _class(rb"[!-~](?<![\"'`()\[\]{}<>,;])"), _class(rb"[A-Za-z_\-]")


def _identifiers(batches):
    import pyarrow as pa

    hasher = WordHasher(drop_punctuation=False)
    hasher.fold[~_LETTERS] = 0
    for batch in batches:
        for _, _, raw, offsets in chunks(batch):
            h, a, b = hasher(raw)
            long = b - a >= IDENTIFIER
            h, a, b = h[long], a[long], b[long]
            doc = np.searchsorted(offsets, a, "right")
            order = np.lexsort((doc, h))
            h, doc, a, b = h[order], doc[order], a[order], b[order]
            fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]) if len(h) else np.zeros(0, bool)
            h, a, b = h[fresh], a[fresh], b[fresh]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
            data = raw.tobytes()
            words = [data[i:j].decode("ascii") for i, j in zip(a[first].tolist(), b[first].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(np.diff(np.append(first, len(h))).astype(np.int64))], ["word", "n"])


def identifier_dictionary(docs: DataFrame, size: int = DICTIONARY, min_docs: int = MIN_DOCS) -> bytes:
    """Names common in code, then the identifiers that fill most bytes of the corpus (once a document), the first of them last."""
    words = docs.where("text IS NOT NULL").select("text").mapInArrow(_identifiers, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_docs)
    filled = F.col("n") * F.length("word")
    words = cut(words.select("word", filled.alias("filled"), F.floor(F.log2(filled) * 16).cast("int").alias("class")))
    # no more than these can fit: each takes IDENTIFIER bytes and a space at least; a histogram of at most a thousand classes tells from which class on they are
    most, least, found = size // (IDENTIFIER + 1), None, 0
    for r in words.groupBy("class").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("class")).collect():
        least, found = r["class"], found + r["n"]
        if found >= most:
            break
    top = words.where(F.col("class") >= (least or 0)).orderBy(F.desc("filled"), "word").limit(most).collect()
    kept, used = [], 0
    for r in top:
        used += len(r["word"]) + 1
        if used > size:
            break
        kept.append(r["word"])
    return (_NAMES + " " + " ".join(reversed(kept))).encode()


class Novelty:
    """Marginal compressed bytes of a string in its surroundings."""

    def __init__(self, dictionary: bytes) -> None:
        import zstandard

        primed = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        params = zstandard.ZstdCompressionParameters.from_level(9, write_content_size=False, write_checksum=False, write_dict_id=False)
        primed.precompute_compress(compression_params=params)
        self.compressor = zstandard.ZstdCompressor(dict_data=primed, compression_params=params)

    def __call__(self, candidate: bytes, before: bytes, after: bytes) -> int:
        # other copies of the candidate nearby don't make it known
        before, after = before.replace(candidate, b""), after.replace(candidate, b"")
        size = lambda x: len(self.compressor.compress(x))
        # a few bytes more can change how a block codes its literals: the median of three surroundings counts
        return sorted(size(x + candidate) - size(x) for x in (before + after, before, after))[1]


def names(data: bytes) -> list[tuple[int, str]]:
    """(end, name) of the sensitive names, in order."""
    low, out = data.lower(), []
    for core in (*_ALONE, *_WITHIN, _KEY):
        at = low.find(core)
        while at >= 0:
            end = at + len(core)
            left = data[max(0, at - 12) : at]
            begins = core in _WITHIN or bool(_BEFORE.search(left)) or left[-1:].islower() and data[at : at + 1].isupper()
            if core == _KEY:
                fits = _COMPANY.search(left) and _AFTER.match(data, end) or begins and _VALUED.match(data, end)
            else:
                fits = begins and _AFTER.match(data, end)
            if fits:
                out.append((end, core.decode()))
            at = low.find(core, end)
    return sorted(out)


def find(raw: np.ndarray, offsets: np.ndarray, novelty: Novelty, min_chars: int, least: float) -> list[tuple[int, int, int, str, int, float]]:
    """(text, first character, length, sensitive name, marginal bytes, novelty) of the secrets; every text ends with a line feed."""
    a, b = _runs(raw, _CANDIDATE, min_chars)
    if not len(a):
        return []
    data = raw.tobytes()
    named = names(data)
    blocks = []
    for m in _BLOCK.finditer(data):
        stop = int(offsets[np.searchsorted(offsets, m.start(), "right")])
        ends = [e for e in (data.find(b"-----END", m.end(), stop), data.find(b"\n\n", m.end(), stop)) if e >= 0]
        blocks.append((m.end(), min(ends, default=stop)))
    if not named and not blocks:
        return []
    name_ends, block_starts = (np.array([x for x, _ in y], np.int64) for y in (named, blocks))
    # a line's or a sentence's end parts names from candidates
    stops = ((raw == 46) | (raw == 33) | (raw == 63)) & np.append((raw[1:] == 32) | (raw[1:] == 9), False) | (raw == 10)
    parted = np.concatenate([[0], np.cumsum(stops)])
    characters = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    out, used, told = [], -1, -1  # the last name with a candidate, where its candidates end
    for i, j in zip(a.tolist(), b.tolist()):
        cut = _PREFIX.match(data, i, j)
        if cut and j - cut.end() >= min_chars:
            i = cut.end()
        while j - i > min_chars and data[j - 1] in b".:":
            j -= 1
        k = int(np.searchsorted(block_starts, i, "right")) - 1
        name = "privatekey" if k >= 0 and i < blocks[k][1] else None
        if name is None:
            k = int(np.searchsorted(name_ends, i, "right")) - 1
            if k < 0 or parted[i] > parted[named[k][0]] or k == used and not _APART.fullmatch(data, told, i):
                continue
            used, told, name = k, j, named[k][1]
        d = int(np.searchsorted(offsets, i, "right")) - 1
        lo, hi = int(offsets[d]), int(offsets[d + 1]) - 1
        added = novelty(data[i:j], data[max(lo, i - AROUND) : i], data[j : min(hi, j + AROUND)])
        wordy = not any(48 <= c < 58 for c in data[i:j])
        if added >= (max(least, WORDY_NOVELTY) if wordy else least) * (j - i):
            out.append((d, int(characters[i] - characters[lo]), j - i, name, added, round(added / (j - i), 4)))
    return out


def scan(docs: DataFrame, min_chars: int = MIN_CHARS, least: float = NOVELTY, dictionary: bytes | None = None) -> DataFrame:
    """doc_id, start, length, named, added_bytes, novelty of each secret."""
    words = identifier_dictionary(docs) if dictionary is None else dictionary
    fixed = docs.sparkSession.sparkContext.broadcast(words)  # DICTIONARY bytes and a list of names

    def run(batches):
        import pyarrow as pa

        novelty = Novelty(fixed.value)
        for batch in batches:
            for lo, hi, raw, offsets in chunks(batch):
                got = find(raw, offsets, novelty, min_chars, least)
                if got:
                    doc, first, length, name, added, share = (list(x) for x in zip(*got))
                    ids = batch.column("doc_id").slice(lo, hi - lo).take(pa.array(doc))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(first, pa.int64()), pa.array(length, pa.int64()), pa.array(name), pa.array(added, pa.int64()), pa.array(share)], ["doc_id", "start", "length", "named", "added_bytes", "novelty"])

    return docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, start long, length long, named string, added_bytes long, novelty double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
