"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names: the rows that each docstring defines."""

import pathlib
import random
import re

import pytest

from lattica.llm import exact_dedup, language_id, line_dedup, lm_score, mixing, ngram_join, packing, quality_rules, secret_scan, substring_dedup

from .test_operators import SCHEMA, prose, table

LONG = prose(random.Random(9), 30_000)
ROWS = [
    (1, None, "a"), (2, "", "a"), (3, "  \n\t ", "b"), (4, LONG, "b"), (4, LONG, "b"), (None, "of and the " + prose(random.Random(3), 40), None), (7, "one", None), (8, LONG + " end", "a"),
    (4, "other text of the same id", "a"), (None, None, None), (9, "é ü ß\n...\nx", "b"), (10, "one", "a"), (11, "", "a"),
]
OPERATORS = {
    "line_dedup": lambda d: line_dedup.drop_recurring(d, min_docs=2),
    "line_dedup_first": lambda d: line_dedup.drop_recurring(d, keep="first", min_docs=2),
    "ngram_join": ngram_join.near_documents,
    "ngram_join_filter": ngram_join.drop_near_copies,
    "lm_score": lm_score.score,
    "lm_score_joined": lambda d: lm_score.score(d, broadcast_grams=0),
    "substring_dedup": substring_dedup.maximal_repeats,
    "substring_dedup_hot": lambda d: substring_dedup.maximal_repeats(d, hot=0),
    "language_id": lambda d: language_id.identify(d, language_id.train(language_id.sample(d))),
    "packing": packing.pack,
    "secret_scan": lambda d: secret_scan.scan(d),
    "exact_dedup": exact_dedup.exact_duplicates,
    "mixing": lambda d: mixing.select_mixture(d, total=10**7),
    "mixing_part": mixing.select_target,
    "quality_rules": quality_rules.judge,
    "quality_filter": quality_rules.keep_good,
}
FILTERS = {"line_dedup", "line_dedup_first", "ngram_join_filter", "mixing", "mixing_part", "quality_filter"}


def plain(df, columns=None):
    return sorted((tuple(r) for r in df.select(*[f"`{c}`" for c in columns or df.columns]).collect()), key=repr)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, ROWS)


@pytest.fixture(scope="module")
def crowded(docs):
    """The same with a column of every name that the operators use, but those of documents."""
    folder = pathlib.Path(line_dedup.__file__).parent
    text = "".join(f.read_text() for f in folder.glob("*.py"))
    names = set(re.findall(r"[\"']([a-z_][a-z0-9_]{0,20})[\"']", text)) | set(re.findall(r"\b__lt_\w+", text)) | {"m", "c", "e", "__lt_n"}
    names = sorted({n.lower() for n in names} - {"doc_id", "text", "lang", "source", "n_chars"})
    assert len(names) > 80
    return docs.selectExpr("*", *[f"{i} AS `{n}`" for i, n in enumerate(names)])


@pytest.mark.parametrize("name", list(OPERATORS))
def test_clashing_names_change_nothing(docs, crowded, name):
    want, got = OPERATORS[name](docs), OPERATORS[name](crowded)
    if name in FILTERS:
        assert got.columns == crowded.columns and want.columns == docs.columns
    assert plain(got, want.columns) == plain(want)


@pytest.mark.parametrize("name", list(OPERATORS))
def test_empty_tables_give_nothing(spark, name):
    assert OPERATORS[name](spark.createDataFrame([], SCHEMA)).collect() == []


def test_rows_of_pairs_and_copies(docs):
    links = plain(ngram_join.near_documents(docs))
    assert links == [(10, 7, 1), (4, 4, 1), (7, 7, 1), (8, 4, 1)]
    assert sorted(map(repr, (r["doc_id"] for r in ngram_join.drop_near_copies(docs).collect()))) == sorted(map(repr, [1, 2, 3, 4, 4, None, 7, None, 9, 11]))
    assert plain(substring_dedup.maximal_repeats(docs)) == [(4, 0, 30000, 4, 0), (8, 0, 30000, 4, 0)]
    assert plain(exact_dedup.exact_duplicates(docs)) == [(10, 7, 2), (11, 2, 2), (4, 4, 2)]
    assert secret_scan.scan(docs).collect() == []


def test_scores_and_languages(docs):
    scores = plain(lm_score.score(docs))
    assert [s for s in scores if s[1] == 0] == [(1, 0, None), (11, 0, None), (2, 0, None), (None, 0, None)]
    by = {(i, n): b for i, n, b in scores}
    assert by[7, 3] == by[10, 3] and len([s for s in scores if s[:2] == (4, len(LONG.encode()))]) == 2 and len(scores) == len(ROWS)
    found = plain(language_id.identify(docs, language_id.train(language_id.sample(docs))))
    assert sorted((i for i, f, _ in found if f is None), key=repr) == sorted([1, 2, 3, 11, None], key=repr) and {x[1:] for x in found} == {(None, None), ("germanic", "en")}


def test_filters_and_packs(docs):
    good = [r["doc_id"] for r in quality_rules.keep_good(docs).collect()]
    assert sorted(good, key=repr) == sorted([4, 4, None, 7, 8, 4, 10], key=repr)
    assert plain(line_dedup.drop_recurring(docs)) == plain(docs)
    whole = {(r["doc_id"], r["text"]) for r in mixing.select_mixture(docs, total=10**7).collect()}
    assert whole == {(i, t) for i, t, _ in ROWS if t and t.strip()}
    places = plain(packing.pack(docs))
    assert sorted((p[2] for p in places if p[0] is None), key=repr) == sorted([1, 2, 3, 11, None], key=repr)
    assert sum(p[5] for p in places if p[2] == 8) == len(LONG.split()) + 1 and max(p[1] + p[5] for p in places if p[0] is not None) <= packing.CAPACITY


def test_line_dedup_of_repeated_rows_and_nulls(spark):
    rows = [(1, "a line of four\nkept", "a")] * 2 + [(2, "x\na line of four", "a"), (None, "a line of four", "a"), (3, None, "a"), (4, "", "a")]
    got = plain(line_dedup.drop_recurring(table(spark, rows), keep="first", min_docs=2), ["doc_id", "text", "n_chars"])
    assert got == sorted([(1, "a line of four\nkept", 19), (1, "a line of four\nkept", 19), (2, "x", 1), (None, "", 0), (3, None, None), (4, "", 0)], key=repr)


def test_exact_dedup_where_texts_share_a_fingerprint(spark):
    from pyspark.sql import functions as F

    rows = [(1, "ab", "a"), (2, "cd", "a"), (3, "ab", "a"), (None, "cd", "a"), (2, "cd", "a"), (4, "ef", "a"), (5, None, "a"), (6, "xyz", "a"), (None, "xyz", "a"), (7, "long", "a"), *[(8, "many", "a")] * 5000, (9, "", "a"), (9, "", "a")]
    docs = table(spark, rows)
    want = sorted([(3, 1, 2), (None, 2, 3), (2, 2, 3), (None, 6, 2), *[(8, 8, 5000)] * 4999, (9, 9, 2)], key=repr)
    assert plain(exact_dedup.exact_duplicates(docs)) == want
    assert plain(exact_dedup.exact_duplicates(docs, F.length("text").cast("long"))) == want
    assert plain(exact_dedup.exact_duplicates(table(spark, [(None, "a", "x")] * 3))) == [(None, None, 3)] * 2
