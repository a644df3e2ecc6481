"""Language ID against a text-by-text version of features, margins and votes."""

import random

import numpy as np
import pytest

from lattica.llm import language_id

from .test_operators import table

STEMS = {"en": ["th", "ing", "er", "ou", "wh"], "de": ["sch", "ung", "ich", "ße", "ei"], "fr": ["eau", "é", "tion", "oi", "que"], "es": ["ción", "ado", "ñ", "ll", "ar"], "xx": ["zz", "qq"]}


def make(r, lang, n):
    return " ".join("".join(r.choice(STEMS[lang]) for _ in range(r.randrange(1, 4))) for _ in range(n))


def fold(text):
    out = []
    for b in (text + "\n").encode():
        c = chr(b)
        out.append(b + 32 if "A" <= c <= "Z" else b if "a" <= c <= "z" or b > 126 or b < 9 or 13 < b < 32 else 32)
    return out


def brute_features(text):
    b, x = fold(text), {}
    for k in (1, 2, 3):
        for i in range(len(b) - k + 1):
            g = (k - 1 << 24) + sum(v << 8 * (k - 1 - j) for j, v in enumerate(b[i : i + k]))
            at = (g * 2654435761 % (1 << 32)) >> (32 - language_id.BITS)
            x[at] = x.get(at, 0) + 1
    return {k: v / (3 * len(b)) for k, v in x.items()}


def brute_identify(model, text):
    if all(b == 32 for b in fold(text or "")):
        return None, None
    x = brute_features(text)
    margin = {(k, a, b): sum(v * float(w[i]) for i, v in x.items()) + float(w[-1]) for k, a, b, w in model["models"]}

    def winner(kind, names):
        votes, sums = {n: 0 for n in names}, {n: 0.0 for n in names}
        for (k, a, b), m in margin.items():
            if k == kind and a in names and b in names:
                votes[a if m > 0 else b] += 1
                sums[a] += np.tanh(m)
                sums[b] -= np.tanh(m)
        return max(names, key=lambda n: (votes[n], sums[n]))

    family = winner("family", model["families"])
    return family, winner("language", [l for l in model["languages"] if language_id.family_of(l) == family])


@pytest.mark.parametrize("seed", [1, 2])
def test_identify_equals_brute_force(spark, seed):
    r = random.Random(seed)
    model = language_id.train([(make(r, l, 30), l) for l in STEMS for _ in range(12)])
    assert {k for k, *_ in model["models"]} == {"family", "language"} and len(model["families"]) == 3
    texts = [make(r, l, n) for l in STEMS for n in (1, 2, 5, 40)] + ["", None, " \n", "123 !?", "é", "ABC", "a", make(r, "en", 5) + " " + make(r, "fr", 5), make(r, "de", 20_000), "zz\n\nqq", "ab", "ab"]
    docs = table(spark, [(i, t, "a") for i, t in enumerate(texts)])
    for parts in (1, 5):
        got = {x["doc_id"]: (x["family"], x["lang"]) for x in language_id.identify(docs.repartition(parts), model).collect()}
        assert [got[i] for i in range(len(texts))] == [brute_identify(model, t) for t in texts]


def test_training_and_prediction_see_the_same_features():
    r = random.Random(4)
    texts = [make(r, l, n) for l in STEMS for n in (1, 3, 20)] + ["", "a"]
    data = [(t + "\n").encode() for t in texts]
    raw, offsets = np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])])
    x = language_id.features(raw, offsets)
    for row, text in zip(x, texts):
        want = np.zeros(1 << language_id.BITS)
        for k, v in brute_features(text).items():
            want[k] = v
        assert np.allclose(row[:-1], want, atol=1e-6)


def test_sample_takes_the_bound_of_each_language(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "en" if i % 3 else "de") for i in range(60)] + [(99, None, "fr"), (98, "x", None)], "doc_id long, text string, lang string")
    got = language_id.sample(docs, 7)
    assert sorted(l for _, l in got) == ["de"] * 7 + ["en"] * 7
    assert language_id.sample(docs.repartition(5), 7) == got
