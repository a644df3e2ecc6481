"""Language ID: family first, then one-versus-one linear SVMs within the family.

Features are relative frequencies of hashed byte n-grams (1 to 3 bytes within
and across words, case folded) over the whole text. A linear SVM for each pair
of families, and one for each pair of languages of a family, are trained here
by dual coordinate descent; a text's family has most votes of the first kind,
its language most of the second kind, ties going to the larger summed margin.

Training reads at most ``PER_LANGUAGE`` labelled rows a language, those of
least hash; that bound is the only one, and scoring covers every text.

Defined results: ``doc_id`` is a column of integers. A null or blank text, or
one without a letter's byte, gets null family and language; one of any length is
read whole. Languages without an entry in ``FAMILIES`` are a family each. Ties of
votes and margins go to the name that comes first. Repeated rows are scored
each; rows alike in text and language train once. An empty table gives an empty
result, and without labelled rows all are null. Columns besides doc_id, text and
lang aren't read, so their names don't matter.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import chunks, table

PER_LANGUAGE, BITS, COST, EPOCHS, SEED = 300, 14, 1e4, 20, 7
#: Tables of up to this many languages are broadcast.
BROADCAST_LANGUAGES = 10_000
FAMILIES = {
    **dict.fromkeys(("en", "de", "nl", "sv", "da", "no", "is", "af"), "germanic"),
    **dict.fromkeys(("fr", "es", "it", "pt", "ro", "ca", "gl"), "romance"),
    **dict.fromkeys(("ru", "pl", "cs", "uk", "bg", "sr", "hr", "sk", "sl"), "slavic"),
}
_BIAS = np.float32(0.05)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32
#: Digits, ASCII punctuation and spaces only part words.
for _c in range(33, 127):
    if not chr(_c).isalpha():
        _FOLD[_c] = 32


def _codes(raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Bucket of the 1-, 2- and 3-byte gram that ends at each byte; -1 where it would reach back over its text's start."""
    x = _FOLD[raw].astype(np.uint32)
    one, two, three = x, x.copy(), x.copy()
    two[1:] += (x[:-1] << np.uint32(8)) + np.uint32(1 << 24)
    three[2:] += (x[1:-1] << np.uint32(8)) + (x[:-2] << np.uint32(16)) + np.uint32(2 << 24)
    codes = [((g * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int32) for g in (one, two, three)]
    for k in (1, 2):
        for back in range(k):
            at = offsets[:-1] + back
            codes[k][at[at < offsets[1:]]] = -1
    return codes


def features(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of relative gram frequencies for each text (the training side)."""
    out = np.zeros((len(offsets) - 1, (1 << BITS) + 1), np.float32)
    codes = _codes(raw, offsets)
    for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
        for g in codes:
            out[i, :-1] += np.bincount(g[a:b][g[a:b] >= 0], minlength=1 << BITS)
        out[i] /= max(1, 3 * (b - a))
    out[:, -1] = _BIAS
    return out


def train_svm(x: np.ndarray, y: np.ndarray, cost: float = COST, epochs: int = EPOCHS, seed: int = SEED) -> np.ndarray:
    """Weights (the last is the bias) of an L1-loss linear SVM, by dual coordinate descent; y is 1 or -1."""
    alpha, w, norm = np.zeros(len(x)), np.zeros(x.shape[1], np.float32), np.einsum("ij,ij->i", x, x)
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(x)):
            g = y[i] * (x[i] @ w) - 1
            new = min(max(alpha[i] - g / norm[i], 0.0), cost)
            if new != alpha[i]:
                w += np.float32((new - alpha[i]) * y[i]) * x[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    w[-1] *= _BIAS
    return w


def family_of(lang: str) -> str:
    return FAMILIES.get(lang, lang)


def train(rows: list[tuple[str, str]]) -> dict:
    """The model from (text, language) rows: names, and for each pair its two sides and weights."""
    data = [(t or "").encode() + b"\n" for t, _ in rows]
    raw = np.frombuffer(b"".join(data), np.uint8)
    x = features(raw, np.concatenate([[0], np.cumsum([len(d) for d in data], dtype=np.int64)]).astype(np.int64))
    lang = np.array([l for _, l in rows])
    langs = sorted(set(lang))
    families = sorted({family_of(l) for l in langs})
    fam = np.array([family_of(l) for l in lang])
    jobs = [("family", a, b, fam) for a, b in combinations(families, 2)]
    jobs += [("language", a, b, lang) for f in families for a, b in combinations([l for l in langs if family_of(l) == f], 2)]
    models = []
    for kind, a, b, label in jobs:
        some = (label == a) | (label == b)
        models.append((kind, a, b, train_svm(x[some], np.where(label[some] == a, 1.0, -1.0))))
    return {"languages": langs, "families": families, "models": models}


def _vote(names: list[str], pairs: list[tuple[str, str]], margins: np.ndarray) -> np.ndarray:
    """Index of the winner for each row of margins (positive: the pair's first)."""
    votes = np.zeros((len(margins), len(names)))
    for j, (a, b) in enumerate(pairs):
        m = margins[:, j]
        ia, ib = names.index(a), names.index(b)
        votes[:, ia] += (m > 0) + 1e-6 * np.tanh(m)
        votes[:, ib] += (m <= 0) - 1e-6 * np.tanh(m)
    return votes.argmax(1)


def predict(model: dict, raw: np.ndarray, offsets: np.ndarray) -> tuple[list, list]:
    """(family, language) of each text; None where no letter is."""
    n = len(offsets) - 1
    if not n or not model["languages"]:
        return [None] * n, [None] * n
    codes = _codes(raw, offsets)
    has = np.add.reduceat((_FOLD[raw] != 32).astype(np.int64), offsets[:-1]) > 0
    length = np.maximum(1, 3 * np.diff(offsets))
    margins = []
    for _, _, _, w in model["models"]:
        ext = np.append(w[:-1], np.float32(0))  # -1: the appended 0
        total = sum(np.add.reduceat(ext[g].astype(np.float64), offsets[:-1]) for g in codes)
        margins.append(total / length + w[-1])
    margins = np.array(margins, float).reshape(len(model["models"]), n).T
    kinds = [k for k, *_ in model["models"]]
    first = [j for j, k in enumerate(kinds) if k == "family"]
    family = _vote(model["families"], [model["models"][j][1:3] for j in first], margins[:, first])
    language = np.empty(n, object)
    for i, f in enumerate(model["families"]):
        mine = [l for l in model["languages"] if family_of(l) == f]
        at = np.flatnonzero(family == i)
        use = [j for j, (k, a, _, _) in enumerate(model["models"]) if k == "language" and a in mine]
        pick = _vote(mine, [model["models"][j][1:3] for j in use], margins[np.ix_(at, use)]) if use else np.zeros(len(at), int)
        language[at] = np.array(mine, object)[pick]
    return [model["families"][f] if h else None for f, h in zip(family, has)], [l if h else None for l, h in zip(language, has)]


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> list[tuple[str, str]]:
    """Up to ``per_language`` labelled (text, lang) rows a language, of least hash."""
    keyed = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    # only hashes are ranked; the texts follow for the few that stay
    by = Window.partitionBy("lang").orderBy("h")
    few = keyed.select("lang", "h").withColumn("r", F.row_number().over(by)).where(F.col("r") <= per_language).groupBy("lang").agg(F.max("h").alias("most"))
    few = F.broadcast(few) if few.count() <= BROADCAST_LANGUAGES else few
    rows = keyed.join(few, "lang").where("h <= most").dropDuplicates(["lang", "h"]).select("text", "lang").collect()
    return sorted((r["text"], r["lang"]) for r in rows)


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, family, lang of every document by ``model``."""
    fixed = docs.sparkSession.sparkContext.broadcast(model)  # sized by the bucket count and the number of languages

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for lo, hi, raw, offsets in chunks(batch):
                family, language = predict(fixed.value, raw, offsets)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(family, pa.string()), pa.array(language, pa.string())], ["doc_id", "family", "lang"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, family string, lang string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(sample(docs)))
