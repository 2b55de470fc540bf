"""Queries of the keyword mode."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stem
from ..operators import filters, keyword, keyword_index
from ..plans.oracle_tables import D, P, with_tables
from ..sources import graph_tables as g
from . import _indexes

ACROSS, PHRASES, NEGATED, FOLDED = "fox from are OR thor inti", '"of the" from OR "en la"', 'from -thor OR "de la"', "PartNo0-src10 OR zzzz"


def _search(spark, sf_dir, text):
    return keyword_index.search(_indexes.keywords(spark, sf_dir), text).withColumn("score", F.round("score", 9))


def q6_1_query_forms(spark, sf_dir):
    """Every title as a query: its lexemes, and those of its folded form."""
    operands, folded = keyword.query_terms(F.col("title"))
    return g.documents(spark, sf_dir).select(F.col("title").alias("query"), operands.alias("operands"), folded.alias("folded")).distinct()


def q6_1_stems(spark, sf_dir):
    """The stem of every word of the texts."""
    docs = g.table(spark, sf_dir, "documents")
    return stem.stems(docs.select(F.explode(keyword.words(F.col("text"))).alias("word")))


def q6_4_across_document(spark, sf_dir):
    return _search(spark, sf_dir, ACROSS).select("document_id", "matched_passages")


def q6_4_phrases(spark, sf_dir):
    return _search(spark, sf_dir, PHRASES).select("document_id", "matched_passages")


def q6_5_single_unit(spark, sf_dir):
    return _search(spark, sf_dir, NEGATED).select("document_id", "matched_passages")


def q6_6_ranking(spark, sf_dir):
    return _search(spark, sf_dir, ACROSS).select("document_id", "score", "chunk_index")


def q6_8_provenance(spark, sf_dir):
    """A folded query that only surfaces satisfy; the abstract moves scores, not matches."""
    return _search(spark, sf_dir, FOLDED).select("document_id", "score")


def q6_6_ranking_scan(spark, sf_dir):
    """The same search by a scan of all texts, as it is for tables without an index."""
    found = keyword.keyword_search(g.passages(spark, sf_dir), keyword.surfaces(g.documents(spark, sf_dir)), ACROSS)
    return found.select("document_id", F.round("score", 9).alias("score"), "chunk_index")


def q6_10_keyword_mode(spark, sf_dir):
    visible = filters.document_filter({"exclude_lifecycle": ["completed"]}, exclude_failed=True)
    page = keyword_index.keyword_mode(g.documents(spark, sf_dir), _indexes.keywords(spark, sf_dir), ACROSS, visible, 25)
    return page.select("document_id", F.round("score", 9).alias("score"), "rank")


def q6_10_list_all(spark, sf_dir):
    visible = filters.document_filter({"exclude_lifecycle": ["completed"]}, exclude_failed=True)
    return keyword_index.keyword_mode(g.documents(spark, sf_dir), None, "*", visible, 2**31 - 1).select("document_id", "rank")


def q6_11_advice(spark, sf_dir):
    texts = ["the of", "-fox", '"no such phrase"', "absentword nosuchword", "fox -absent", "absentword", "from"]
    index = _indexes.keywords(spark, sf_dir)
    rows = [(t, line) for t in texts for line in keyword.advice(t, int(not keyword_index.search(index, t).isEmpty()))]
    return spark.createDataFrame(rows, "query string, advice string")


def q7_10_title_ranks(spark, sf_dir):
    """Where every active document stands for its own title, however it is typed, with passages addressed and relative to it."""
    titles = g.documents(spark, sf_dir).where("lifecycle_status = 'active'").select(F.col("id").alias("document_id"), "title")
    return keyword_index.title_ranks({"before": _indexes.addressed_keywords(spark, sf_dir), "after": _indexes.structured_keywords(spark, sf_dir)}, titles)


def q18_13_title_rank_summary(spark, sf_dir):
    return keyword_index.title_rank_summary(q7_10_title_ranks(spark, sf_dir))


QUERIES = {n: f for n, f in list(globals().items()) if n.startswith("q") and callable(f)}

_LEX = f"list_transform(regexp_extract_all(lower(coalesce({{0}}, '')), '[a-z0-9]+'), lambda w: {stem.stem_sql('w')})"
_UNITS = f"""su AS (SELECT id AS document_id, concat_ws(' ', title, array_to_string(tags, ' '), regexp_extract(source_path, '([^/]*)[.]md$', 1)) AS m, semantic_abstract AS o FROM d),
u AS (
  SELECT document_id, chunk_index, {_LEX.format("content")} AS lex, {_LEX.format("content")} AS wide FROM p
  UNION ALL SELECT document_id, NULL, {_LEX.format("m")}, {_LEX.format("concat_ws(' ', m, o)")} FROM su),
t AS (SELECT *, ' ' || array_to_string(lex, ' ') || ' ' AS pad FROM u)"""


def _has(*operands):
    return " AND ".join(f"contains(pad, ' {o} ')" for o in operands)


def _rank(terms, weight):
    return "(" + " + ".join(f"coalesce(list_sum(list_transform(range(1, len(list_filter(wide, lambda w: w = '{t}')) + 1), lambda j: {weight} / (j * j))), 0)" for t in terms) + f") / 1.64493406685 / {len(terms)}"


_OPS = ("fox", "from", "inti", "thor")  # 'are' is a stop word
_DOCS = f"""{_UNITS}, h AS (
  SELECT document_id, count(*) FILTER (chunk_index IS NOT NULL AND ({" OR ".join(_has(o) for o in _OPS)})) AS matched_passages, {", ".join(f"bool_or({_has(o)}) AS {o}_" for o in _OPS)} FROM t GROUP BY 1),
hit AS (SELECT document_id, matched_passages FROM h WHERE fox_ AND from_ OR thor_ AND inti_)"""
_SCORED = f"""{_DOCS}, s AS (
  SELECT document_id, chunk_index, CASE WHEN chunk_index IS NULL THEN {_rank(_OPS, 1.0)} ELSE {_rank(_OPS, 0.1)} END AS score, {" OR ".join(_has(o) for o in _OPS)} AS any_ FROM t),
b AS (SELECT document_id, max(score) FILTER (any_ OR chunk_index IS NULL) AS score, min([-score, chunk_index]) FILTER (any_ AND chunk_index IS NOT NULL) AS best FROM s GROUP BY 1)"""



def keyword_arm(term):
    """The keyword arm of a fusion for one word, as SQL."""
    return f"""{_UNITS}, kw0 AS (SELECT document_id, chunk_index, {_has(term)} AS hit, CASE WHEN chunk_index IS NULL THEN {_rank((term,), "1.0")} ELSE {_rank((term,), "0.1")} END AS sc FROM t),
  kw AS (SELECT document_id, CAST(row_number() OVER (ORDER BY score DESC, document_id) AS INTEGER) AS rank FROM (SELECT document_id, round(max(sc) FILTER (hit OR chunk_index IS NULL), 9) AS score FROM kw0 GROUP BY 1 HAVING bool_or(hit)))"""


#: Titles are Src<number>-<language>_PartNo<digit>: as typed, a phrase of three lexemes; with separators folded, three words.
_TITLE_RANKS = f"""su AS (SELECT id AS document_id, concat_ws(' ', title, array_to_string(tags, ' '), regexp_extract(source_path, '([^/]*)[.]md$', 1)) AS m, semantic_abstract AS o FROM d),
tu AS (
  SELECT a.arm, document_id, chunk_index, {_LEX.format("CASE WHEN arm = 'before' THEN heading_path ELSE string_split(heading_path, ' > ')[2] END || ' ' || content")} AS lex, lex AS wide FROM p, (VALUES ('before'), ('after')) a(arm)
  UNION ALL SELECT a.arm, document_id, NULL, {_LEX.format("m")}, {_LEX.format("concat_ws(' ', m, o)")} FROM su, (VALUES ('before'), ('after')) a(arm)),
ti AS MATERIALIZED (SELECT DISTINCT title, {_LEX.format("title")} AS q FROM d WHERE lifecycle_status = 'active'),
tt AS MATERIALIZED (SELECT *, ' ' || array_to_string(lex, ' ') || ' ' AS pad FROM tu),
th AS MATERIALIZED (
  SELECT title, arm, document_id, chunk_index, contains(pad, ' ' || array_to_string(q, ' ') || ' ') AS phrase, contains(pad, ' ' || q[1] || ' ') AS x, contains(pad, ' ' || q[2] || ' ') AS y, contains(pad, ' ' || q[3] || ' ') AS z,
    CASE WHEN chunk_index IS NULL THEN 1.0 ELSE 0.1 END * list_sum(list_transform(q, lambda l: coalesce(list_sum(list_transform(range(1, len(list_filter(wide, lambda w: w = l)) + 1), lambda j: 1.0 / (j * j))), 0))) / 1.64493406685 / 3 AS sc
  FROM tt JOIN ti ON list_has_any(wide, q)),
tf AS (
  SELECT title, arm, document_id, TRUE AS folded, round(max(sc) FILTER (x OR y OR z OR chunk_index IS NULL), 9) AS score FROM th GROUP BY ALL HAVING bool_or(x) AND bool_or(y) AND bool_or(z)
  UNION ALL
  SELECT title, arm, document_id, FALSE, round(max(sc) FILTER (phrase OR chunk_index IS NULL), 9) FROM th GROUP BY ALL HAVING bool_or(phrase) OR bool_or(x AND y AND z AND chunk_index IS NULL)),
tk AS (SELECT *, row_number() OVER (PARTITION BY arm, title, folded ORDER BY score DESC, document_id) AS rank FROM tf),
tr AS (
  SELECT a.arm, r.rendering, d.id AS document_id, CAST(CASE WHEN tk.rank <= 20 THEN tk.rank END AS INTEGER) AS rank
  FROM d CROSS JOIN (VALUES ('before'), ('after')) a(arm) CROSS JOIN (VALUES ('verbatim', FALSE), ('lowercase', FALSE), ('uppercase', FALSE), ('separators folded', TRUE)) r(rendering, folded)
  LEFT JOIN tk ON tk.arm = a.arm AND tk.title = d.title AND tk.folded = r.folded AND tk.document_id = d.id WHERE d.lifecycle_status = 'active')"""

ORACLE = {
    "q6_1_stems": f"SELECT word, {stem.stem_sql('word')} AS lexeme FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM documents)",
    "q7_10_title_ranks": with_tables(f"{_TITLE_RANKS} SELECT * FROM tr", D, P),
    "q18_13_title_rank_summary": with_tables(f"{_TITLE_RANKS} SELECT arm, rendering, count(*) AS eligible, count(*) FILTER (rank = 1) AS rank_1, count(rank) AS recalled FROM tr GROUP BY 1, 2", D, P),
    "q6_6_ranking_scan": with_tables(f"{_SCORED} SELECT document_id, round(score, 9) AS score, CAST(best[2] AS INTEGER) AS chunk_index FROM hit JOIN b USING (document_id)", D, P),
    "q6_1_query_forms": with_tables(f"SELECT DISTINCT title AS query, array_to_string(list_sort(list_distinct({_LEX.format('title')})), ' ') AS operands, array_to_string(list_sort(list_distinct({_LEX.format('title')})), ' ') AS folded FROM d", D),
    "q6_4_across_document": with_tables(f"{_DOCS} SELECT * FROM hit", D, P),
    "q6_4_phrases": with_tables(f"""{_UNITS}, h AS (
      SELECT document_id, count(*) FILTER (chunk_index IS NOT NULL AND ({_has("of the")} OR {_has("from")} OR {_has("en la")})) AS matched_passages, bool_or({_has("of the")}) AND bool_or({_has("from")}) OR bool_or({_has("en la")}) AS ok FROM t GROUP BY 1)
      SELECT document_id, matched_passages FROM h WHERE ok""", D, P),
    "q6_5_single_unit": with_tables(f"""{_UNITS}, w AS (SELECT *, ({_has("from")} OR {_has("de la")}) AND NOT contains(pad, ' thor ') AS ok FROM t)
      SELECT document_id, count(*) FILTER (chunk_index IS NOT NULL) AS matched_passages FROM w WHERE ok GROUP BY 1""", D, P),
    "q6_6_ranking": with_tables(f"{_SCORED} SELECT document_id, round(score, 9) AS score, CAST(best[2] AS INTEGER) AS chunk_index FROM hit JOIN b USING (document_id)", D, P),
    "q6_8_provenance": with_tables(f"""{_UNITS} SELECT document_id, round({_rank(("partno0", "src10", "zzzz"), "1.0")}, 9) AS score FROM t
      WHERE chunk_index IS NULL AND ({_has("partno0", "src10")} OR {_has("zzzz")})""", D, P),
    "q6_10_keyword_mode": with_tables(f"""{_SCORED}, v AS (SELECT id FROM d WHERE lifecycle_status <> 'completed' AND (pipeline_status <> 'failed' OR projection_scope IN ('limited', 'complete')))
      SELECT document_id, round(score, 9) AS score, CAST(row_number() OVER (ORDER BY score DESC, document_id) AS INTEGER) AS rank FROM hit JOIN b USING (document_id) WHERE document_id IN (SELECT id FROM v) ORDER BY rank LIMIT 25""", D, P),
    "q6_10_list_all": with_tables("""SELECT id AS document_id, CAST(row_number() OVER (ORDER BY id) AS INTEGER) AS rank FROM d WHERE lifecycle_status <> 'completed' AND (pipeline_status <> 'failed' OR projection_scope IN ('limited', 'complete'))""", D),
    "q6_11_advice": with_tables(f"""{_UNITS}, ad(query, advice, found) AS (
      SELECT 'the of', 'only common words: the of', FALSE
      UNION ALL SELECT '-fox', 'only exclusions', EXISTS (SELECT 1 FROM t WHERE NOT {_has("fox")})
      UNION ALL SELECT '"no such phrase"', 'a phrase must stand in one passage', EXISTS (SELECT 1 FROM t WHERE {_has("no such phrase")})
      UNION ALL SELECT 'absentword nosuchword', 'every word must occur; OR allows any', EXISTS (SELECT 1 FROM t WHERE {_has("absentword")} OR {_has("nosuchword")})
      UNION ALL SELECT 'fox -absent', 'exclusions hold the whole query to one passage', EXISTS (SELECT 1 FROM t WHERE {_has("fox")} AND NOT {_has("absent")}))
      SELECT query, advice FROM ad WHERE NOT found""", D, P),
}
