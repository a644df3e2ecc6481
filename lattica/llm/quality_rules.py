"""Quality rules: a threshold table compiled into one Spark projection.

``METRICS`` names the statistics as Spark SQL expressions, ``RULES`` is the
threshold table. Both compile into one projection of built-in expressions: no user
function, no shuffle, one pass over the texts.

Defined results: a null or blank text has no words, every ratio of it is 0 and
it fails ``few_words``. A text of any length is read whole. A value equal to a
threshold fails no rule. Repeated rows are judged each on its own. An empty table
gives an empty result. Columns of the input with names of metrics don't matter:
only ``doc_id`` (of any type) and ``text`` are read, and the filter returns the
input's own columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW, packed, table, unpacked, words_of

STOP_WORDS = {
    "en": "the be to of and that have with is in it for on as this are was by at from or an a he not you which but".split(),
    "de": "der die das und in den von zu mit ist für im auf ein eine des dem sich nicht als auch es an".split(),
    "fr": "le la les de des et en un une du est que qui dans pour par sur au il ne pas plus avec ce".split(),
    "es": "el la los las de y en un una que es por con para del se al su lo no como más".split(),
}
_STOP = sorted({w for ws in STOP_WORDS.values() for w in ws})
_SYMBOLS = r"[#$%&*|<>{}\[\]~^=+\\/_@!]"
_STOP_LIST = ", ".join(f"'{w}'" for w in _STOP)


@dataclass(frozen=True)
class Rule:
    """A document fails when ``metric`` is under ``least`` or over ``most``, if it has ``from_words`` words."""

    name: str
    metric: str
    least: float | None = None
    most: float | None = None
    from_words: int = 0


RULES = (
    Rule("few_words", "n_words", least=1),
    Rule("short_words", "mean_word_chars", least=1.5, from_words=3),
    Rule("long_words", "mean_word_chars", most=25.0, from_words=3),
    Rule("symbols", "symbol_ratio", most=0.3, from_words=3),
    # in a word or two a mark such as "!" is no fault yet
    Rule("mostly_symbols", "symbol_ratio", most=1.5, from_words=1),
    Rule("no_stop_words", "stop_ratio", least=0.02, from_words=30),
    Rule("only_stop_words", "stop_ratio", most=0.8, from_words=30),
    Rule("repeated_words", "repeat_ratio", most=0.4, from_words=10),
    Rule("repeated_lines", "line_repeat_ratio", most=0.6, from_words=10),
    Rule("bullet_lines", "bullet_ratio", most=0.9, from_words=10),
    Rule("cut_lines", "ellipsis_ratio", most=0.5, from_words=10),
)
METRICS = ("n_chars", "n_words", "mean_word_chars", "symbol_ratio", "stop_ratio", "repeat_ratio", "line_repeat_ratio", "bullet_ratio", "ellipsis_ratio")


def _counts(text: Column) -> dict[str, Column]:
    """Integer statistics of a text; every ratio divides two of these."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x != "")
    return {
        "n_chars": F.length(text),
        "n_words": words_of(text),
        "bare": F.length(F.regexp_replace(text, r"[ \t\r\n\f\x0B]+", "")),
        "symbols": F.length(text) - F.length(F.regexp_replace(text, _SYMBOLS + "+", "")),
        "words": words,
        "lines": lines,
    }


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(F.floor(a * 1e6 / b + 0.5) / 1e6)


def _metrics() -> dict[str, Column]:
    """The metrics from the counts in the column ``c``."""
    c = {k: F.col(f"c.{k}") for k in ("n_chars", "n_words", "bare", "symbols", "words", "lines")}
    words, lines = c["words"], c["lines"]
    # a word that equals the one before it
    again = F.size(F.filter(F.arrays_zip(words.alias("a"), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))).alias("b")), lambda p: p["a"] == p["b"]))
    return {
        "n_chars": c["n_chars"].cast("long"),
        "n_words": c["n_words"].cast("long"),
        "mean_word_chars": _ratio(c["bare"], c["n_words"]),
        "symbol_ratio": _ratio(c["symbols"], c["n_words"]),
        "stop_ratio": _ratio(F.size(F.filter(words, lambda w: w.isin(_STOP))), F.size(words)),
        "repeat_ratio": _ratio(again, F.size(words)),
        "line_repeat_ratio": _ratio(F.size(lines) - F.size(F.array_distinct(lines)), F.size(lines)),
        "bullet_ratio": _ratio(F.size(F.filter(lines, lambda x: x.rlike(r"^ *([-*•]|[0-9]+[.)]) "))), F.size(lines)),
        "ellipsis_ratio": _ratio(F.size(F.filter(lines, lambda x: x.endswith("...") | x.endswith("…"))), F.size(lines)),
    }


def _struct(columns: dict[str, Column]) -> Column:
    """One struct, computed once: the optimizer doesn't copy expressions out of a generator."""
    return F.explode(F.array(F.struct(*[v.alias(k) for k, v in columns.items()])))


def _fails(rule: Rule, value: dict[str, Column]) -> Column:
    out = F.lit(False)
    if rule.least is not None:
        out = out | (value[rule.metric] < rule.least)
    if rule.most is not None:
        out = out | (value[rule.metric] > rule.most)
    return out & (value["n_words"] >= rule.from_words) if rule.from_words else out


def measured(rows: DataFrame, text: Column, rules=RULES) -> DataFrame:
    """``rows`` and the columns ``m``, a struct of the metrics of ``text``, and ``failed``, the rules it fails joined by commas."""
    kept = [F.col(f"`{c}`") for c in rows.columns]
    counted = rows.select(*kept, _struct(_counts(text)).alias("c"))
    valued = counted.select(*kept, _struct(_metrics()).alias("m"))
    value = {m: F.col(f"m.{m}") for m in METRICS}
    return valued.select(*kept, "m", F.concat_ws(",", *[F.when(_fails(r, value), F.lit(r.name)) for r in rules]).alias("failed"))


def judge(docs: DataFrame, rules=RULES) -> DataFrame:
    """doc_id, every metric, ``failed`` (names of rules, empty if none) and ``keep`` of every document."""
    out = measured(docs.select(F.struct("doc_id", "text").alias(ROW)), F.col(f"{ROW}.text"), rules)
    return out.select(F.col(f"{ROW}.doc_id").alias("doc_id"), "m.*", "failed", (F.col("failed") == "").alias("keep"))


def keep_good(docs: DataFrame, rules=RULES) -> DataFrame:
    """The documents that fail no rule, with the input's columns."""
    return unpacked(measured(packed(docs), F.col(f"{ROW}.text"), rules).where("failed = ''"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


def metrics_sql(source: str = "documents") -> str:
    """DuckDB's CTEs ``c`` (counts) and ``m`` (metrics, with ``failed``) over ``source``, all columns kept."""
    ws = r"[ \t\r\n\f\x0B]+"
    r = lambda a, b: f"CASE WHEN {b} = 0 THEN 0.0 ELSE floor({a} * 1e6::DOUBLE / {b} + 0.5) / 1e6 END"
    tests = []
    for x in RULES:
        t = " OR ".join([f"{x.metric} < {x.least}"] * (x.least is not None) + [f"{x.metric} > {x.most}"] * (x.most is not None))
        tests.append(f"CASE WHEN ({t}) AND n_words >= {x.from_words} THEN '{x.name}' END")
    return rf"""
c AS (SELECT *, len(list_filter(regexp_split_to_array(t, '{ws}'), lambda w: w <> '')) AS w_n,
    length(regexp_replace(t, '{ws}', '', 'g')) AS bare,
    length(t) - length(regexp_replace(t, '{_SYMBOLS}+', '', 'g')) AS symbols,
    list_filter(regexp_split_to_array(lower(t), '[^\p{{L}}]+'), lambda w: w <> '') AS words,
    list_filter(string_split(t, chr(10)), lambda w: w <> '') AS ls
  FROM (SELECT *, coalesce(text, '') AS t FROM {source})),
k AS (SELECT *, len(list_filter(words, lambda w: w IN ({_STOP_LIST}))) AS stops,
    len(list_filter(list_zip(words, words[2:]), lambda p: p[1] = p[2])) AS again,
    len(list_filter(ls, lambda x: regexp_matches(x, '^ *([-*•]|[0-9]+[.)]) '))) AS bullets,
    len(list_filter(ls, lambda x: suffix(x, '...') OR suffix(x, '…'))) AS cuts FROM c),
m0 AS (SELECT * EXCLUDE (n_chars, w_n), length(t)::BIGINT AS n_chars, w_n::BIGINT AS n_words,
    {r("bare", "w_n")} AS mean_word_chars, {r("symbols", "w_n")} AS symbol_ratio,
    {r("stops", "len(words)")} AS stop_ratio, {r("again", "len(words)")} AS repeat_ratio,
    {r("(len(ls) - len(list_distinct(ls)))", "len(ls)")} AS line_repeat_ratio,
    {r("bullets", "len(ls)")} AS bullet_ratio, {r("cuts", "len(ls)")} AS ellipsis_ratio FROM k),
m AS (SELECT *, concat_ws(',', {", ".join(tests)}) AS failed FROM m0)"""


ORACLE_SQL = f"WITH {metrics_sql()} SELECT doc_id, {', '.join(METRICS)}, failed, failed = '' AS keep FROM m"
