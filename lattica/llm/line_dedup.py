"""Line dedup: a log-template tree of fixed depth over all lines of a corpus.

A line's white space is normalised and every word with a digit becomes ``<*>``.
The tree's levels are its number of words and its first ``depth`` words; a leaf
holds all lines that agree there. In a leaf a field is variable where its word
isn't shared by ``min_docs`` documents at that place: such words generalise to
``<*>``. A line's template is what remains. Templates seen in ``min_docs``
documents or more recur, and their lines are dropped.

Everything is a grouped count, so the result doesn't depend on the order of
lines and a leaf needn't fit in one task. Leaves with fewer than ``min_docs``
documents can hold no recurring template and go no further than their count. A
line that ``min_docs`` documents share settles its words and its template by
itself, so documents are counted only through lines of fewer.

Defined results: ``doc_id`` may be of any type that has an order. Lines of under
``min_words`` words, and templates of which under ``min_constant`` of the words
are constant, are never dropped; counts equal to a bound reach it. Rows with one
doc_id are one document, and a null doc_id is counted as no document (lines of
such rows are dropped all the same). A null text stays null, an empty one empty,
one of any length is read whole, and rows that repeat stay as many. With
``keep="first"`` the document of least doc_id keeps a recurring template's
lines, with ``keep="none"`` no document does. An empty table gives an empty
result. Columns besides doc_id, text and n_chars pass through unread, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import cut
from .common import ROW, WS, bounded, packed, table, unpacked

DEPTH, MIN_DOCS, MIN_WORDS, MIN_CONSTANT = 3, 10, 4, 0.6
#: Tables of documents with the hashes of the lines they lose are broadcast up to this many rows.
BROADCAST_DOCS = 200_000


def masked(line: Column) -> Column:
    """The line with single spaces and ``<*>`` for words that hold a digit."""
    odd = F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" "))
    for x in ("  ", "\t", "\r", "\f", "\x0b"):
        odd = odd | F.contains(line, F.lit(x))
    even = F.when(odd, F.trim(F.regexp_replace(line, WS, " "))).otherwise(line)
    return F.when(line.rlike("[0-9]"), F.regexp_replace(even, "[^ 0-9]*+[0-9][^ ]*", "<*>")).otherwise(even)


def _lines(docs: DataFrame, depth: int, min_words: int, min_constant: float) -> DataFrame:
    """doc_id, th (hash of the text), m, mh (its hash), leaf, firm (enough of its words hold no digit) of every line of enough words."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("th"), F.explode(F.split("text", "\n")).alias("line"))
    # the one-element array keeps the optimizer from computing the mask once for each use
    lines = lines.select("doc_id", "th", F.explode(F.array(masked(F.col("line")))).alias("m"))
    lines = lines.where((F.col("m") != "") & (F.substring_index("m", " ", min_words - 1) != F.col("m")) if min_words > 1 else F.col("m") != "")
    n = F.length("m") - F.length(F.replace("m", F.lit(" "), F.lit(""))) + 1
    apart = F.concat(F.lit(" "), F.replace("m", F.lit(" "), F.lit("  ")), F.lit(" "))
    wild = (F.length(apart) - F.length(F.replace(apart, F.lit(" <*> "), F.lit("")))) / 5
    firm = F.when(F.contains("m", F.lit("<*>")), n - wild >= n * min_constant).otherwise(True)
    return lines.select("doc_id", "th", "m", F.xxhash64("m").alias("mh"), F.xxhash64(n, F.substring_index("m", " ", depth)).alias("leaf"), firm.alias("firm"))


def _tree(docs: DataFrame, depth: int = DEPTH, min_docs: int = MIN_DOCS, min_words: int = MIN_WORDS, min_constant: float = MIN_CONSTANT) -> tuple[DataFrame, DataFrame]:
    """(leaf, mh, doc_id, th: the lines of leaves of enough documents; leaf, mh, first_doc: the recurring ones).

    Lines move as hashes. Only leaves in which some line doesn't recur as it
    stands are read again for their words, each line in one document.
    """
    known = cut(_lines(docs, depth, min_words, min_constant).select("leaf", "mh", "firm", "doc_id", "th").distinct())
    leaves = known.groupBy("leaf").agg(F.count_distinct("doc_id").alias("d")).where(F.col("d") >= min_docs).select("leaf")
    held = cut(known.join(leaves, "leaf", "left_semi"))
    kinds = cut(held.groupBy("leaf", "mh", "firm").agg(F.count_distinct("doc_id").alias("k"), F.min("doc_id").alias("least"), F.min("th").alias("th")))
    # lines that need their documents counted together with those of others
    rare = kinds.where(F.col("k") < min_docs)
    mixed = cut(rare.select("leaf").distinct())
    wanted = kinds.join(mixed, "leaf", "left_semi").select("leaf", "mh", "th", (F.col("k") >= min_docs).alias("sure"))
    keys = cut(wanted.select(F.col("th").alias("__lt_th")).distinct())
    sources = packed(docs.select("doc_id", "text"), __lt_t=F.xxhash64("text")).join(bounded(keys), F.col("__lt_t") == F.col("__lt_th"), "left_semi").select(f"{ROW}.*")
    texts = _lines(sources, depth, min_words, min_constant).select("leaf", "mh", "m").join(wanted.select("leaf", "mh", "sure"), ["leaf", "mh"])
    words = cut(texts.groupBy("leaf", "mh", "sure").agg(F.min("m").alias("m")).select("leaf", "mh", "sure", F.posexplode(F.split("m", " ")).alias("pos", "word")))
    few = cut(held.join(rare.select("leaf", "mh"), ["leaf", "mh"], "left_semi").select("leaf", "mh", "doc_id").distinct())
    # a word is constant by one line of many documents, or by the documents of all its lines
    real = words.where("word <> '<*>'")
    sure = real.where("sure").select("leaf", "pos", "word").distinct()
    counted = real.where("NOT sure").join(few, ["leaf", "mh"]).groupBy("leaf", "pos", "word").agg(F.count_distinct("doc_id").alias("d")).where(F.col("d") >= min_docs)
    constant = sure.unionByName(counted.select("leaf", "pos", "word")).distinct()
    built = (
        words.join(constant.withColumn("fixed", F.lit(True)), ["leaf", "pos", "word"], "left")
        .groupBy("leaf", "mh")
        .agg(F.array_sort(F.collect_list(F.struct("pos", F.when(F.col("fixed"), F.col("word")).otherwise("<*>").alias("w")))).alias("ws"), F.count("fixed").alias("fixed"), F.count(F.lit(1)).alias("all"))
        .select("leaf", "mh", F.xxhash64(F.array_join(F.col("ws.w"), " ")).alias("template"), (F.col("fixed") >= F.col("all") * min_constant).alias("firm"))
    )
    # a line of a leaf where all recur is its own template; of its words only those with digits vary
    own = kinds.join(mixed, "leaf", "left_anti").select("leaf", "mh", F.col("mh").alias("template"), "firm")
    every = cut(built.unionByName(own).where("firm").drop("firm").join(kinds.select("leaf", "mh", "k", "least"), ["leaf", "mh"]))
    seen = every.groupBy("leaf", "template").agg(F.max("k").alias("most"), F.sum("k").alias("upto"), F.min("least").alias("first_doc"))
    open_ = every.join(seen.where((F.col("most") < min_docs) & (F.col("upto") >= min_docs)).select("leaf", "template"), ["leaf", "template"], "left_semi")
    together = open_.join(few, ["leaf", "mh"]).groupBy("leaf", "template").agg(F.count_distinct("doc_id").alias("d")).where(F.col("d") >= min_docs).select("leaf", "template")
    recurring = seen.where(F.col("most") >= min_docs).select("leaf", "template", "first_doc").unionByName(seen.join(together, ["leaf", "template"]).select("leaf", "template", "first_doc"))
    return held.select("leaf", "mh", "doc_id", "th"), cut(every.join(recurring, ["leaf", "template"]).select("leaf", "mh", "first_doc"))


def _hits(docs: DataFrame, keep: str, **parameters) -> DataFrame:
    """doc_id, th (hash of the text), mh: the masked lines that each document loses."""
    held, found = _tree(docs, **parameters)
    hit = held.join(bounded(found), ["leaf", "mh"])
    return hit.where(~F.col("doc_id").eqNullSafe(F.col("first_doc"))) if keep == "first" else hit


def drop_recurring(docs: DataFrame, keep: str = "none", **parameters) -> DataFrame:
    """The input's rows and columns; ``text`` without lines of recurring templates, ``n_chars`` (if there) to match."""
    gone = _hits(docs, keep, **parameters).groupBy("doc_id", "th").agg(F.collect_set("mh").alias("__lt_gone"))
    gone = bounded(cut(gone.select(F.col("doc_id").alias("__lt_id"), F.col("th").alias("__lt_th"), "__lt_gone")), BROADCAST_DOCS)
    rows = packed(docs, __lt_id0=F.col("doc_id"), __lt_th0=F.xxhash64("text"))
    joined = rows.join(gone, (F.col("__lt_th0") == F.col("__lt_th")) & F.col("__lt_id0").eqNullSafe(F.col("__lt_id")), "left")
    text = F.col(f"{ROW}.text")
    left = F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(F.col("__lt_gone"), F.xxhash64(masked(x))))
    cleaned = F.when(F.col("__lt_gone").isNull(), text).otherwise(F.array_join(left, "\n"))
    row = F.col(ROW).withField("text", cleaned)
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        row = row.withField("n_chars", F.when(F.col("__lt_gone").isNull(), F.col(f"{ROW}.n_chars")).otherwise(F.length(cleaned).cast(kind)))
    return unpacked(joined.select(row.alias(ROW)))


def clean(docs: DataFrame, keep: str = "none", **parameters) -> DataFrame:
    """doc_id, text, n_chars of every document after its recurring lines are gone."""
    rows = docs.select("doc_id", "text", F.length("text").cast("long").alias("n_chars"))
    return drop_recurring(rows, keep, **parameters)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(table(spark, sf_dir, "documents"))


def cleaned_sql(source: str, keep: str = "none", prefix: str = "ld_") -> str:
    """DuckDB's CTEs that end in ``{prefix}out``: the rows of ``source`` with ``text`` cleaned (null doc_ids need the Spark side)."""
    p = prefix
    first = "AND x.doc_id IS DISTINCT FROM s.first_doc" if keep == "first" else ""
    return rf"""
{p}src AS (SELECT *, row_number() OVER () AS row_no FROM {source}),
{p}cut AS (SELECT row_no, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM {p}src WHERE text IS NOT NULL),
{p}msk AS (SELECT *, regexp_replace(trim(regexp_replace(line, '[ \t\r\n\f\x0B]+', ' ', 'g')), '[^ ]*[0-9][^ ]*', '<*>', 'g') AS m FROM {p}cut),
{p}lin AS (SELECT *, string_split(m, ' ') AS ws, len(string_split(m, ' ')) AS n FROM {p}msk WHERE m <> '' AND len(string_split(m, ' ')) >= {MIN_WORDS}),
{p}lea AS (SELECT *, n || ' ' || array_to_string(ws[1:{DEPTH}], ' ') AS leaf FROM {p}lin),
{p}hot AS (SELECT leaf FROM {p}lea GROUP BY leaf HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
{p}shr AS (SELECT DISTINCT leaf, m, ws, doc_id FROM {p}lea WHERE leaf IN (SELECT leaf FROM {p}hot)),
{p}con AS (SELECT leaf, pos, word FROM (SELECT leaf, doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM {p}shr) WHERE word <> '<*>' GROUP BY ALL HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
{p}bld AS (SELECT k.leaf, k.m, string_agg(CASE WHEN c.word IS NULL THEN '<*>' ELSE k.word END, ' ' ORDER BY k.pos) AS template
  FROM (SELECT leaf, m, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM (SELECT DISTINCT leaf, m, ws FROM {p}shr)) k LEFT JOIN {p}con c ON k.leaf = c.leaf AND k.pos = c.pos AND k.word = c.word
  GROUP BY k.leaf, k.m HAVING count(c.word) >= count(*) * {MIN_CONSTANT}),
{p}see AS (SELECT leaf, template, min(doc_id) AS first_doc FROM {p}shr JOIN {p}bld USING (leaf, m) GROUP BY ALL HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
{p}gon AS (SELECT x.row_no, x.line_no FROM {p}lea x JOIN {p}bld b USING (leaf, m) JOIN {p}see s USING (leaf, template) WHERE true {first}),
{p}fix AS (SELECT c.row_no, coalesce(string_agg(c.line, chr(10) ORDER BY c.line_no) FILTER (WHERE g.line_no IS NULL), '') AS t FROM {p}cut c LEFT JOIN {p}gon g USING (row_no, line_no) GROUP BY c.row_no HAVING count(g.line_no) > 0),
{p}out AS (SELECT s.* REPLACE (CASE WHEN f.row_no IS NULL THEN s.text ELSE f.t END AS text, CASE WHEN f.row_no IS NULL THEN s.n_chars ELSE length(f.t)::BIGINT END AS n_chars) FROM {p}src s LEFT JOIN {p}fix f USING (row_no))"""


ORACLE_SQL = f"WITH {cleaned_sql('(SELECT doc_id, text, length(text)::BIGINT AS n_chars FROM documents)')} SELECT doc_id, text, n_chars FROM ld_out"
