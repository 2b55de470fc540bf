"""Passage, text, search, evaluation, lifecycle, inference and telemetry queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import evaluation, graph, inference, lifecycle, passages, search, selection
from ..plans.oracle_tables import D, E, P, V, with_tables
from ..sources import graph_tables as g
from ..streaming import feeds
from . import _indexes
from .keyword import keyword_arm

TERMS = ("the", "that")
AS_OF = "2025-01-01T00:00:00"


def _light(spark, sf_dir):
    return g.documents(spark, sf_dir)


def _query_vector(spark, sf_dir):
    return g.table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()[0]


def q12_13_headings(spark, sf_dir):
    return passages.headings(g.passages(spark, sf_dir))


def q13_3_sections(spark, sf_dir):
    return passages.sections(g.passages(spark, sf_dir)).select("document_id", "section", "first_chunk", "passages", F.md5("text").alias("digest"))


def q13_6_document_text(spark, sf_dir):
    return passages.document_text(g.passages(spark, sf_dir)).select("document_id", "sections", F.md5("text").alias("digest"))


def q13_5_read_section(spark, sf_dir):
    return passages.read_section(g.passages(spark, sf_dir), "d00000010", "Src10-fr_PartNo0").select("section", "heading_path", F.md5("text").alias("digest"))


def q13_2_split_passages(spark, sf_dir):
    pieces = passages.split_lines(_light(spark, sf_dir).select(F.col("id").alias("document_id"), "text"), 1000)
    # No piece could have taken any of the next one in.
    after = F.lead(F.length("text")).over(Window.partitionBy("document_id").orderBy("piece"))
    rows = pieces.withColumn("full", F.coalesce(F.length("text") + after > 1000, F.lit(True)))
    whole = F.md5(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("piece", "text"))), lambda p: p["text"]), ""))
    return rows.groupBy("document_id").agg((F.max(F.length("text")) <= 1000).alias("bounded"), F.min("full").alias("full"), (F.min(F.length("text")) > 0).alias("filled"), whole.alias("digest"))


def q12_15_storage(spark, sf_dir):
    return passages.storage_counts(g.passages(spark, sf_dir))


def q6_9_folding(spark, sf_dir):
    return _light(spark, sf_dir).select("id", t.fold_for_query(F.col("title")).alias("folded"))


def q13_7_structure(spark, sf_dir):
    rows = g.passages(spark, sf_dir)
    return rows.select("document_id", "chunk_index", t.indexed_structure(F.col("heading_path"), F.split("heading_path", " > ")[0]).alias("structure"))


def q13_12_slug(spark, sf_dir):
    return _light(spark, sf_dir).select("id", t.slug(F.col("title")).alias("slug"), t.document_id(F.col("source_path"), F.col("created_at"), F.col("title")).alias("document_id"))


def q13_15_rationale(spark, sf_dir):
    return g.edges(spark, sf_dir).groupBy(t.rationale_kind(F.col("rationale")).alias("kind")).agg(F.count("*").alias("edges"))


def q14_14_lexical_class(spark, sf_dir):
    rows = _light(spark, sf_dir).select(F.explode(F.array("document_date", "title", F.col("n").cast("string"), "authority_scope", F.col("metadata_confirmed").cast("string"))).alias("v"))
    return rows.groupBy(t.lexical_class(F.col("v")).alias("kind")).agg(F.count("*").alias("n"))


def q6_12_keyword(spark, sf_dir):
    return search.keyword_search(g.passages(spark, sf_dir), TERMS, 25).select("document_id", F.round("score", 9).alias("score"), "chunk_index", "matched_sections", "matched_passages", "rank")


def _vector_hits(spark, sf_dir, limit, arm=None):
    return search.vector_hits(_indexes.passage_vectors(spark, sf_dir), _indexes.surface_vectors(spark, sf_dir), g.vectors(spark, sf_dir), _query_vector(spark, sf_dir), limit, arm)


def q7_1_vector(spark, sf_dir):
    return _vector_hits(spark, sf_dir, 20, 60)


def q7_1_vector_scan(spark, sf_dir):
    """The same search without an index."""
    return search.vector_search(g.vectors(spark, sf_dir), _query_vector(spark, sf_dir), 20, 60)


def q7_3_fusion(spark, sf_dir):
    arms = [_vector_hits(spark, sf_dir, 60), search.keyword_search(g.passages(spark, sf_dir), TERMS, 60)]
    return search.reciprocal_rank_fusion(arms, 30).select("document_id", F.round("score", 9).alias("score"), "rank")


def q7_5_metadata_matches(spark, sf_dir):
    return search.metadata_matches(_light(spark, sf_dir), "src1")


def q7_5_boosted(spark, sf_dir):
    """The fused hits lifted by titles and tags that hold the query."""
    hits = q7_3_fusion(spark, sf_dir).select("document_id", "score")
    return search.boost_metadata(hits, search.metadata_matches(_light(spark, sf_dir), "src1")).select("document_id", F.round("score", 9).alias("score"))


def _hybrid(spark, sf_dir, text):
    docs, index = _light(spark, sf_dir), _indexes.keywords(spark, sf_dir)
    found = search.hybrid_search(docs, lambda cut: [_vector_hits(spark, sf_dir, cut), search.keyword_hits(index, text, cut)], text, AS_OF)
    return found.select("document_id", "title", "lifecycle_status", F.round("score", 6).alias("score"), "rank")


def q7_8_hybrid(spark, sf_dir):
    """A text that titles and tags hold: the metadata boost lifts them."""
    return _hybrid(spark, sf_dir, "src1")


def q7_8_hybrid_abstracts(spark, sf_dir):
    """A word of the texts: the abstract boost lifts documents that start with it."""
    return _hybrid(spark, sf_dir, "from")


def q18_3_relevance(spark, sf_dir):
    docs = _light(spark, sf_dir)
    ranking = docs.select(F.concat(F.lit("q"), F.floor(F.col("n") / 20).cast("string")).alias("query"), F.col("id").alias("document_id"), F.row_number().over(Window.partitionBy(F.floor(F.col("n") / 20)).orderBy(F.col("n") * 7 % 101, "n")).alias("rank"))
    judged = docs.where("n % 7 = 0 or n % 11 = 0").select(F.concat(F.lit("q"), F.floor(F.col("n") / 20).cast("string")).alias("query"), F.col("id").alias("document_id"), F.when(F.col("n") % 7 == 0, 2).otherwise(1).alias("grade"))
    return evaluation.relevance(ranking, judged, 5)


def q18_1_overlap(spark, sf_dir):
    docs = _light(spark, sf_dir)
    key = F.floor(F.col("n") / 20).alias("query")
    one = evaluation.lists(docs.select(key, F.col("id").alias("document_id"), F.row_number().over(Window.partitionBy(F.floor(F.col("n") / 20)).orderBy(F.col("n") * 7 % 101, "n")).alias("rank")).where("rank <= 5"))
    two = evaluation.lists(docs.select(key, F.col("id").alias("document_id"), F.row_number().over(Window.partitionBy(F.floor(F.col("n") / 20)).orderBy(F.col("n") * 5 % 89, "n")).alias("rank")).where("rank <= 5"))
    both = one.join(two.withColumnRenamed("documents", "other"), "query")
    return both.select("query", evaluation.overlap_at_k(F.col("documents"), F.col("other"), 5).alias("overlap"))


def q18_9_latency(spark, sf_dir):
    return evaluation.latency(g.table(spark, sf_dir, "events"), "event_type", "value")


def q11_9_timing_windows(spark, sf_dir):
    events = g.table(spark, sf_dir, "events")
    return events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.max("value"), 6).alias("most")).select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", "most")


def _measured(spark, sf_dir):
    return g.table(spark, sf_dir, "events").select("ts", (F.col("user_id") % 5).cast("string").alias("layer"), F.col("event_type").alias("label"), F.col("value").alias("duration"))


def q11_9_summaries(spark, sf_dir):
    found = feeds.summaries(_measured(spark, sf_dir), 5.0, 40.0)
    return found.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "layer", "label", "n", "suppressed", "warned", "longest")


def q11_9_emitted(spark, sf_dir):
    return feeds.emitted(_measured(spark, sf_dir), 5.0, 40.0).groupBy("layer", "label", "level").agg(F.count("*").alias("n"), F.min("duration").alias("least"), F.max("duration").alias("most"))


def q11_9_sketched(spark, sf_dir):
    """Minutes rolled up by label: the exact p95 by nearest rank, and whether that of the merged sketches is within a hundredth of its rank."""
    rows = _measured(spark, sf_dir)
    rolled = feeds.rolled_up(feeds.summaries(rows, 5.0, 40.0), ["label"]).withColumn("near", F.get("quantiles", F.lit(1)))
    at = rows.where("ts is not null and duration is not null").join(rolled.select("label", "near"), "label").groupBy("label").agg(F.avg((F.col("duration") < F.col("near")).cast("int")).alias("below"), F.avg((F.col("duration") <= F.col("near")).cast("int")).alias("upto"))
    exact = evaluation.latency(rows.where("ts is not null"), "label", "duration").select("label", "p95_nearest")
    return rolled.join(at, "label").join(exact, "label").select("label", "n", "suppressed", "warned", "longest", "p95_nearest", ((F.col("below") <= 0.96) & (F.col("upto") >= 0.94)).alias("sketch_is_near"))


def q10_1_lifecycle(spark, sf_dir):
    docs = _light(spark, sf_dir)
    action = F.element_at(F.array(*[F.lit(a) for a in ("archive", "reactivate", "supersede", "vanish")]), (F.col("n") % 4 + 1).cast("int"))
    requests = docs.select("id", action.alias("action")).unionByName(spark.createDataFrame([("nobody", "archive")], "id string, action string"))
    return lifecycle.set_lifecycle(docs, requests, lifecycle.transitions(spark))


def q10_16_patch_tags(spark, sf_dir):
    docs = _light(spark, sf_dir)
    patches = docs.select("id", F.when(F.col("n") % 3 == 0, F.array(F.lit("en"))).otherwise(F.array(F.lit("new"))).alias("add"), F.when(F.col("n") % 2 == 0, F.array(F.concat(F.lit("pv"), (F.col("n") % 12).cast("string")))).otherwise(F.array(F.lit("none"))).alias("remove"))
    out = lifecycle.patch_tags(docs, patches)
    return out.select("id", F.array_join("tags", ",").alias("tags"), "error")


def q10_4_unique(spark, sf_dir):
    return lifecycle.unique_collisions(_light(spark, sf_dir), g.edges(spark, sf_dir), "report", "sev")


def q2_4_insert_edges(spark, sf_dir):
    edges = g.edges(spark, sf_dir)
    wanted = _light(spark, sf_dir).select(F.col("id"), F.col("id").alias("source_id"), g.ident(F.greatest(F.col("n") - 1, F.lit(0))).alias("target_id"), F.lit("supersedes").alias("edge_type"))
    _, outcome = lifecycle.insert(edges.where("target_id is not null").select("id", "source_id", "target_id", "edge_type"), wanted, ("source_id", "target_id", "edge_type"))
    return outcome.select("id", "created")


def q2_9_remove(spark, sf_dir):
    docs, edges, rows = _light(spark, sf_dir), g.edges(spark, sf_dir), g.passages(spark, sf_dir)
    left, links, parts = lifecycle.remove_documents(docs.where("pipeline_status = 'failed'").select("id"), docs, edges, rows)
    return left.select("id", F.lit("document").alias("what")).unionByName(links.select("id", F.lit("edge").alias("what"))).unionByName(parts.groupBy(F.col("document_id").alias("id")).agg(F.lit("passages").alias("what")))


def q2_8_tombstone(spark, sf_dir):
    docs, edges = _light(spark, sf_dir), g.edges(spark, sf_dir)
    family = graph.lineage(docs.select("id"), edges, starts=docs.where("n = 43").select("id"))
    return lifecycle.tombstone(edges, family, "v2").where("valid_until_version is not null").select("id", "valid_until_version")


def q8_13_validate_links(spark, sf_dir):
    docs = _light(spark, sf_dir)
    links = docs.select(F.col("id").alias("source_id"), g.ident(F.col("n") - F.when(F.col("n") % 5 == 0, 0).when(F.col("n") % 5 == 1, 100000).otherwise(1)).alias("target_id"), F.when(F.col("n") % 13 == 0, "likes").otherwise("supersedes").alias("edge_type"))
    return lifecycle.validate_links(links, _light(spark, sf_dir), g.edges(spark, sf_dir), list(g.POLICIES))


def _items(spark, sf_dir):
    return _light(spark, sf_dir).select("id", F.concat(F.lit("T"), F.floor(F.col("n") / 4).cast("string")).alias("title"), F.lit("p").alias("project"), "doc_type", F.when(F.col("n") % 4 != 0, F.concat(F.lit("v"), (10 - F.col("n") % 4).cast("string"), F.lit(".1"))).alias("version"), (F.col("n") % 3 == 0).alias("is_new"), "n")


def q17_1_version_chains(spark, sf_dir):
    add, gone = inference.version_chain_plan(_items(spark, sf_dir), g.edges(spark, sf_dir))
    return add.select("source_id", "target_id", "tier", F.lit("add").alias("what")).unionByName(gone.select("source_id", "target_id", F.lit(0).alias("tier"), F.lit("remove").alias("what")))


def q17_2_code_matches(spark, sf_dir):
    items = _items(spark, sf_dir).withColumn("codes", F.array(F.concat(F.lit("c"), (F.col("n") % 40).cast("string")), F.concat(F.lit("C"), (F.col("n") % 25).cast("string"))))
    return inference.code_matches(items, ("note", "memo"))


def q17_4_mentions(spark, sf_dir):
    docs = _light(spark, sf_dir)
    texts = docs.select("id", F.concat(F.lit("see REF-"), (F.col("n") * 3 % 50).cast("string"), F.lit(" and REF-"), (F.col("n") % 50).cast("string"), F.lit(".")).alias("text"))
    targets = docs.select(F.concat(F.lit("REF-"), (F.col("n") % 50).cast("string")).alias("identifier"), "id", "lifecycle_status", "updated_at")
    return inference.mention_edges(texts, targets, r"(REF-\d+)", ("active", "completed"))


def q17_5_reconcile(spark, sf_dir):
    edges = g.edges(spark, sf_dir)
    planned = edges.where("edge_type = 'references' and cast(substring(source_id, 2) as int) % 3 = 0").select("source_id", "target_id").unionByName(_light(spark, sf_dir).select(F.col("id").alias("source_id"), F.col("id").alias("target_id")))
    gone, fresh = inference.reconcile(edges, planned)
    return gone.select("source_id", "target_id", F.lit("delete").alias("what")).unionByName(fresh.select("source_id", "target_id", F.lit("create").alias("what")))


def q17_8_source_audit(spark, sf_dir):
    docs = _light(spark, sf_dir)
    files = docs.where("n % 6 != 5").select(F.col("source_path").alias("path"), F.when(F.col("n") % 6 == 4, F.lit("x")).otherwise(F.col("source_content_hash")).alias("hash"), (F.col("n") % 6 == 1).alias("is_symlink"), (F.col("n") % 6 < 3).alias("out_of_root"))
    return inference.source_audit(docs, files)


def q17_22_paths(spark, sf_dir):
    return inference.normal_paths(_light(spark, sf_dir))


def q17_11_purge(spark, sf_dir):
    staged = g.edges(spark, sf_dir).where("edge_type = 'derived_from'").select("source_id", "target_id")
    return inference.purge_window(_light(spark, sf_dir), staged, "2024-01-02T00:00:00", "2024-01-20T00:00:00", ("archived", "completed"))


def q17_12_discovery(spark, sf_dir):
    """Lines of all documents as facts, by document type and section."""
    lines = g.passages(spark, sf_dir).join(_light(spark, sf_dir).select(F.col("id").alias("document_id"), F.col("doc_type").alias("region")), "document_id")
    return inference.discovery_selection(lines.select("region", F.col("section_index").cast("string").alias("field"), F.col("content").alias("text")), 5)


def q17_12_selection(spark, sf_dir):
    """Each document's lines as facts, grouped by section: at most 6 excerpts and 90 words of a document."""
    lines = g.passages(spark, sf_dir).select(F.col("document_id").alias("source"), "heading_path", F.col("chunk_index").alias("place"), F.col("content").alias("text"), F.regexp_count("content", F.lit("[^ ]+")).alias("tokens"))
    found = selection.select_evidence(lines.withColumnRenamed("heading_path", "region").withColumn("field", F.lit("line")), 6, 90)
    return found.select("source", "region", "place", "tokens", "repetitions", F.md5("text").alias("digest"), F.array_join("limits", ",").alias("limits"))


def q17_15_resolved_hashes(spark, sf_dir):
    """Abbreviations of four to seven characters of the content hashes, among all of them, and some that are none."""
    docs = _light(spark, sf_dir)
    short = docs.select(F.expr("CASE WHEN n % 9 = 8 THEN 'zz' || n ELSE substring(source_content_hash, 1, int(3 + n % 5)) END").alias("abbreviation"))
    return selection.resolve_abbreviations(short, docs.select(F.col("source_content_hash").alias("hash")))


def q17_15_failures(spark, sf_dir):
    return inference.failure_rates(g.table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.col("user_id").cast("string").alias("cause")))


QUERIES = {k: v for k, v in list(globals().items()) if k.startswith("q") and callable(v)}

_SECT = """c AS (SELECT *, CASE WHEN section_index = lag(section_index) OVER (PARTITION BY document_id ORDER BY chunk_index) THEN 0 ELSE 1 END AS ch FROM p),
  sec AS (SELECT *, sum(ch) OVER (PARTITION BY document_id ORDER BY chunk_index) AS section FROM c),
  s AS (SELECT document_id, CAST(section AS BIGINT) AS section, min(chunk_index) AS first_chunk, min_by(heading_path, chunk_index) AS heading_path, count(*) AS passages, string_agg(content, '' ORDER BY chunk_index) AS text FROM sec GROUP BY 1, 2)"""
_KEY = """k0 AS (SELECT document_id, chunk_index, section_index, contains(lower(heading_path || ' ' || content), 'the') AS a, contains(lower(heading_path || ' ' || content), 'that') AS b FROM p),
  k1 AS (SELECT *, (a::INT + b::INT) / 2.0 AS sc FROM k0 WHERE a OR b),
  k2 AS (SELECT document_id, max(sc) AS score, arg_min(chunk_index, -sc * 100000 + chunk_index) AS chunk_index, count(DISTINCT section_index) AS matched_sections, count(*) AS matched_passages FROM k1 GROUP BY 1 HAVING bool_or(a) AND bool_or(b)),
  kw AS (SELECT *, CAST(row_number() OVER (ORDER BY score DESC, document_id) AS INTEGER) AS rank FROM k2)"""


def _vec(arm, limit):
    return f"""v1 AS (SELECT v.*, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 6) AS score FROM v),
  v2 AS ((SELECT * FROM v1 WHERE NOT is_surface ORDER BY score DESC, document_id, chunk_index LIMIT {arm}) UNION ALL (SELECT * FROM v1 WHERE is_surface AND authored ORDER BY score DESC, document_id, chunk_index LIMIT {arm})),
  v3 AS (SELECT document_id, max(score) AS score, (array_agg(chunk_index ORDER BY score DESC, chunk_index) FILTER (NOT is_surface))[1] AS chunk_index, count(*) FILTER (NOT is_surface) AS matched_passages, count(*) FILTER (NOT is_surface) = 0 AS is_document_surface FROM v2 GROUP BY 1),
  vr AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (ORDER BY score DESC, document_id) AS INTEGER) AS rank FROM v3) WHERE rank <= {limit})"""


def _rrf(cut, limit):
    return f"""f0 AS (SELECT document_id, rank, 0 AS arm FROM vr UNION ALL SELECT document_id, rank, 1 FROM kw WHERE rank <= {cut}),
  f1 AS (SELECT document_id, round(sum(1.0 / (60 + rank)), 12) AS score, min(arm * 100000 + rank) AS first FROM f0 GROUP BY 1),
  fu AS (SELECT * FROM (SELECT document_id, score, CAST(row_number() OVER (ORDER BY score DESC, first, document_id) AS INTEGER) AS rank FROM f1) WHERE rank <= {limit})"""


_R = "r AS (SELECT n // 20 AS q, id, n, row_number() OVER (PARTITION BY n // 20 ORDER BY n * 7 % 101, n) AS r1, row_number() OVER (PARTITION BY n // 20 ORDER BY n * 5 % 89, n) AS r2 FROM d)"

ORACLE = {
    "q12_13_headings": with_tables("SELECT document_id, heading_path, min(chunk_index) AS first_chunk, count(*) AS passages FROM p GROUP BY 1, 2", P),
    "q13_3_sections": with_tables(f"{_SECT} SELECT document_id, section, first_chunk, passages, md5(text) AS digest FROM s", P),
    "q13_6_document_text": with_tables(f"{_SECT} SELECT document_id, count(*) AS sections, md5(string_agg(text, chr(10) || chr(10) ORDER BY section)) AS digest FROM s GROUP BY 1", P),
    "q13_5_read_section": with_tables(f"{_SECT} SELECT section, heading_path, md5(text) AS digest FROM s WHERE document_id = 'd00000010' AND starts_with(heading_path, 'Src10-fr_PartNo0 > ')", P),
    "q13_2_split_passages": with_tables("SELECT id AS document_id, TRUE AS bounded, TRUE AS \"full\", TRUE AS filled, md5(text) AS digest FROM d WHERE text <> ''", D),
    "q12_15_storage": with_tables("SELECT count(*) AS rows, count(DISTINCT document_id) AS documents, count(*) FILTER (length(content) < 200) AS small_fragments, CAST(sum(strlen(content)) AS BIGINT) AS bytes FROM p", P),
    "q6_9_folding": with_tables("SELECT id, replace(replace(replace(title, '-', ' '), '_', ' '), 'PartNo', 'PartNo') AS folded FROM d", D),
    "q13_7_structure": with_tables("SELECT document_id, chunk_index, string_split(heading_path, ' > ')[2] AS structure FROM p", P),
    "q13_12_slug": with_tables("""s AS (SELECT id, source_path, created_at, trim(regexp_replace(lower(title), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM d)
      SELECT id, slug, substr(sha256(source_path || created_at), 1, 8) || '_' || slug AS document_id FROM s""", D),
    "q13_15_rationale": with_tables("SELECT CASE WHEN rationale LIKE 'inferred:%' THEN 'inferred' ELSE 'manual' END AS kind, count(*) AS edges FROM e GROUP BY 1", E),
    "q14_14_lexical_class": with_tables("""x AS (SELECT unnest([document_date, title, CAST(n AS VARCHAR), authority_scope, CAST(metadata_confirmed AS VARCHAR)]) AS v, unnest(['date', 'identifier', 'number', 'text', 'boolean']) AS kind FROM d)
      SELECT CASE WHEN v IS NULL OR v = '' THEN 'null' ELSE kind END AS kind, count(*) AS n FROM x GROUP BY 1""", D),
    "q6_12_keyword": with_tables(f"{_KEY} SELECT document_id, score, chunk_index, matched_sections, matched_passages, rank FROM kw WHERE rank <= 25", P),
    "q7_1_vector": with_tables(f"{_vec(60, 20)} SELECT document_id, score, chunk_index, matched_passages, is_document_surface, rank FROM vr", V),
    "q7_1_vector_scan": with_tables(f"{_vec(60, 20)} SELECT document_id, score, chunk_index, matched_passages, is_document_surface, rank FROM vr", V),
    "q7_3_fusion": with_tables(f"{_KEY}, {_vec(60, 60)}, {_rrf(60, 30)} SELECT document_id, round(score, 9) AS score, rank FROM fu", P, V),
    "q7_5_metadata_matches": with_tables("""m AS (SELECT id, row_number() OVER (ORDER BY CASE WHEN title ILIKE '%src1%' THEN 0 ELSE 1 END, CASE WHEN source_path ILIKE '%src1%' THEN 0 ELSE 1 END, CASE WHEN lifecycle_status = 'active' THEN 0 ELSE 1 END,
          coalesce(document_date, substr(source_modified_at, 1, 10)) IS NULL, coalesce(document_date, substr(source_modified_at, 1, 10)) DESC NULLS LAST, id) - 1 AS place FROM d WHERE title ILIKE '%src1%' OR array_to_string(tags, ' ') ILIKE '%src1%')
      SELECT id AS document_id, CAST(place AS INTEGER) AS place FROM m WHERE place < 100""", D),
    "q7_5_boosted": with_tables(f"""{_KEY}, {_vec(60, 60)}, {_rrf(60, 30)},
      m AS (SELECT id, row_number() OVER (ORDER BY CASE WHEN title ILIKE '%src1%' THEN 0 ELSE 1 END, CASE WHEN source_path ILIKE '%src1%' THEN 0 ELSE 1 END, CASE WHEN lifecycle_status = 'active' THEN 0 ELSE 1 END,
          coalesce(document_date, substr(source_modified_at, 1, 10)) IS NULL, coalesce(document_date, substr(source_modified_at, 1, 10)) DESC NULLS LAST, id) - 1 AS place FROM d WHERE title ILIKE '%src1%' OR array_to_string(tags, ' ') ILIKE '%src1%'),
      h AS (SELECT document_id, round(score, 9) AS score FROM fu)
      SELECT coalesce(document_id, id) AS document_id, round(CASE WHEN place IS NOT NULL THEN (SELECT max(score) FROM h) + 0.1 - 0.001 * place ELSE score END, 9) AS score
      FROM h FULL JOIN (SELECT * FROM m WHERE place < 100) ON document_id = id""", D, P, V),
    **{name: with_tables(f"""{keyword_arm(text)}, {_vec(150, 150)}, {_rrf(150, 50)},
      vis AS (SELECT * FROM d WHERE pipeline_status <> 'failed' OR projection_scope IN ('limited', 'complete')),
      m AS (SELECT id, row_number() OVER (ORDER BY CASE WHEN title ILIKE '%{text}%' THEN 0 ELSE 1 END, CASE WHEN source_path ILIKE '%{text}%' THEN 0 ELSE 1 END, CASE WHEN lifecycle_status = 'active' THEN 0 ELSE 1 END,
          coalesce(document_date, substr(source_modified_at, 1, 10)) IS NULL, coalesce(document_date, substr(source_modified_at, 1, 10)) DESC NULLS LAST, id) - 1 AS place FROM vis WHERE title ILIKE '%{text}%' OR array_to_string(tags, ' ') ILIKE '%{text}%'),
      h AS (SELECT fu.document_id, fu.score FROM fu JOIN vis ON vis.id = fu.document_id),
      bm AS (SELECT coalesce(h.document_id, m.id) AS document_id, CASE WHEN place IS NOT NULL THEN coalesce((SELECT max(score) FROM h) + 0.1, 1) - 0.001 * place ELSE score END AS score FROM h FULL JOIN (SELECT * FROM m WHERE place < 100) m ON h.document_id = m.id),
      b AS (SELECT bm.document_id, bm.score * CASE WHEN a.id IS NOT NULL THEN 1.3 ELSE 1 END AS score FROM bm LEFT JOIN (SELECT id FROM vis WHERE contains(lower(semantic_abstract), '{text}')
          ORDER BY CASE WHEN lifecycle_status = 'active' THEN 0 ELSE 1 END, document_date IS NULL, document_date DESC NULLS LAST, id LIMIT 100) a ON a.id = bm.document_id),
      z AS (SELECT document_id, title, lifecycle_status, round(score * (1 + coalesce(0.1 * exp(-greatest(date_diff('second', CAST(coalesce(document_date, substr(source_modified_at, 1, 10)) AS TIMESTAMP), TIMESTAMP '2025-01-01') / 86400.0, 0) * ln(2) / 365), 0)), 9) AS score FROM b JOIN vis ON vis.id = document_id)
      SELECT document_id, title, lifecycle_status, round(score, 6) AS score, rank FROM (SELECT *, CAST(row_number() OVER (ORDER BY CASE WHEN lifecycle_status = 'active' THEN 0 ELSE 1 END, score DESC, document_id) AS INTEGER) AS rank FROM z) WHERE rank <= 10""", D, P, V)
      for name, text in (("q7_8_hybrid", "src1"), ("q7_8_hybrid_abstracts", "from"))},
    "q18_3_relevance": with_tables(f"""{_R}, j AS (SELECT q, id, CASE WHEN n % 7 = 0 THEN 2 ELSE 1 END AS grade, CASE WHEN r1 <= 5 THEN r1 END AS rk FROM r WHERE n % 7 = 0 OR n % 11 = 0),
      i AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY grade DESC, id) AS place FROM j)
      SELECT 'q' || q AS query, round(coalesce(sum(grade / log2(rk + 1)) / sum(CASE WHEN place <= 5 THEN grade / log2(place + 1) END), 0), 9) AS ndcg, round(coalesce(1.0 / min(rk), 0), 9) AS reciprocal_rank, CAST(min(rk) IS NOT NULL AS INTEGER) AS success FROM i GROUP BY q""", D),
    "q18_1_overlap": with_tables(f"{_R} SELECT q AS query, count(*) FILTER (r1 <= 5 AND r2 <= 5) / 5.0 AS overlap FROM r GROUP BY q", D),
    "q18_9_latency": """SELECT event_type, count(*) AS n, min(value) AS least, max(value) AS most, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95_interpolated,
      list_sort(list(value))[CAST(ceil(count(*) * 0.95) AS INTEGER)] AS p95_nearest FROM events WHERE value IS NOT NULL GROUP BY 1""",
    "q11_9_summaries": """SELECT strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS start, CAST(user_id % 5 AS VARCHAR) AS layer, event_type AS label, count(*) AS n, count(*) FILTER (value < 5) AS suppressed, count(*) FILTER (value > 40) AS warned, max(value) AS longest
      FROM events WHERE ts IS NOT NULL AND value IS NOT NULL GROUP BY 1, 2, 3""",
    "q11_9_emitted": "SELECT CAST(user_id % 5 AS VARCHAR) AS layer, event_type AS label, CASE WHEN value > 40 THEN 'WARNING' ELSE 'DEBUG' END AS level, count(*) AS n, min(value) AS least, max(value) AS most FROM events WHERE value >= 5 GROUP BY 1, 2, 3",
    "q11_9_sketched": """SELECT event_type AS label, count(*) AS n, count(*) FILTER (value < 5) AS suppressed, count(*) FILTER (value > 40) AS warned, max(value) AS longest, list_sort(list(value))[CAST(ceil(count(*) * 0.95) AS INTEGER)] AS p95_nearest, TRUE AS sketch_is_near
      FROM events WHERE ts IS NOT NULL AND value IS NOT NULL GROUP BY 1""",
    "q11_9_timing_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(max(value), 6) AS most FROM events GROUP BY 1, 2",
    "q10_1_lifecycle": with_tables("""tr(f, a, t, c) AS (VALUES ('(new)', 'ingest', 'active', FALSE), ('active', 'supersede', 'archived', TRUE), ('active', 'archive', 'archived', FALSE), ('active', 'complete', 'completed', FALSE), ('completed', 'archive', 'archived', FALSE),
        ('archived', 'reactivate', 'active', FALSE), ('active', 'relocate', 'relocated', FALSE), ('completed', 'relocate', 'relocated', FALSE)),
      q AS (SELECT id, ['archive', 'reactivate', 'supersede', 'vanish'][n % 4 + 1] AS action, lifecycle_status FROM d UNION ALL SELECT 'nobody', 'archive', NULL)
      SELECT id, action, lifecycle_status, t AS to_state, coalesce(c, FALSE) AS creates_edge, CASE WHEN lifecycle_status IS NULL THEN 'not_found' WHEN action NOT IN (SELECT a FROM tr) THEN 'unknown_action' WHEN t IS NULL THEN 'invalid_transition' END AS error
      FROM q LEFT JOIN tr ON f = lifecycle_status AND a = action""", D),
    "q10_16_patch_tags": with_tables("""q AS (SELECT id, n, tags, CASE WHEN n % 3 = 0 THEN 'en' ELSE 'new' END AS ad, CASE WHEN n % 2 = 0 THEN 'pv' || n % 12 ELSE 'none' END AS rm FROM d),
      e AS (SELECT *, CASE WHEN NOT list_contains(tags, rm) THEN 'remove_absent' WHEN list_contains(tags, ad) AND ad <> rm THEN 'add_present' END AS error FROM q)
      SELECT id, array_to_string(CASE WHEN error IS NULL THEN list_append(list_filter(tags, lambda x: x <> rm), ad) ELSE tags END, ',') AS tags, error FROM e""", D),
    "q10_4_unique": with_tables("""h AS (SELECT id, tier3 ->> '$.sev' AS value FROM d WHERE doc_type = 'report' AND id NOT IN (SELECT target_id FROM e WHERE edge_type = 'supersedes'))
      SELECT value, id, n FROM (SELECT value, id, count(*) OVER (PARTITION BY value) AS n FROM h WHERE value IS NOT NULL) WHERE n > 1""", D, E),
    "q2_4_insert_edges": with_tables("SELECT id, NOT EXISTS (SELECT 1 FROM e WHERE edge_type = 'supersedes' AND e.source_id = d.id AND e.target_id = 'd' || lpad(CAST(greatest(d.n - 1, 0) AS VARCHAR), 8, '0')) AS created FROM d", D, E),
    "q2_9_remove": with_tables("""x AS (SELECT id FROM d WHERE pipeline_status = 'failed')
      SELECT id, 'document' AS what FROM d WHERE pipeline_status <> 'failed' UNION ALL SELECT id, 'edge' FROM e WHERE source_id NOT IN (SELECT id FROM x) AND (target_id IS NULL OR target_id NOT IN (SELECT id FROM x))
      UNION ALL SELECT DISTINCT document_id, 'passages' FROM p WHERE document_id NOT IN (SELECT id FROM x)""", D, E, P),
    "q2_8_tombstone": with_tables("""fam AS (SELECT 'd00000043' AS a UNION SELECT target_id FROM fam JOIN e ON source_id = a WHERE edge_type = 'supersedes')
      SELECT id, coalesce(valid_until_version, 'v2') AS valid_until_version FROM e WHERE valid_until_version IS NOT NULL OR (resolution_policy <> 'none' AND (source_id IN (SELECT a FROM fam) OR target_id IN (SELECT a FROM fam)))""", E),
    "q8_13_validate_links": with_tables("""l AS (SELECT id AS source_id, 'd' || lpad(CAST(n - CASE WHEN n % 5 = 0 THEN 0 WHEN n % 5 = 1 THEN 100000 ELSE 1 END AS VARCHAR), 8, '0') AS target_id, CASE WHEN n % 13 = 0 THEN 'likes' ELSE 'supersedes' END AS edge_type FROM d)
      SELECT source_id, target_id, edge_type, CASE WHEN edge_type = 'likes' THEN 'unknown_type' WHEN source_id = target_id THEN 'self_edge' WHEN target_id NOT IN (SELECT id FROM d) THEN 'target_not_found'
        WHEN EXISTS (SELECT 1 FROM e WHERE e.source_id = l.source_id AND e.target_id = l.target_id AND e.edge_type = l.edge_type) THEN 'already_exists' END AS error FROM l""", D, E),
    "q17_1_version_chains": with_tables("""i AS (SELECT id, n // 4 AS gr, doc_type, CASE WHEN n % 4 <> 0 THEN 10 - n % 4 ELSE -1 END AS ver, n % 3 = 0 AS new FROM d),
      f AS (SELECT gr, doc_type FROM i GROUP BY ALL HAVING count(*) >= 2 AND bool_or(new) AND count(*) FILTER (ver >= 0) >= 1), m AS (SELECT * FROM i JOIN f USING (gr, doc_type)),
      w AS (SELECT gr, doc_type, id AS s, lag(id) OVER (PARTITION BY gr, doc_type ORDER BY ver, id) AS t FROM m),
      old AS (SELECT a.gr, a.doc_type, e.source_id AS s, e.target_id AS t FROM e JOIN m a ON a.id = e.source_id JOIN m b ON b.id = e.target_id AND a.gr = b.gr AND a.doc_type = b.doc_type WHERE e.edge_type = 'supersedes'),
      stale AS (SELECT * FROM old WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.s = old.s AND w.t = old.t))
      SELECT s AS source_id, t AS target_id, CASE WHEN EXISTS (SELECT 1 FROM stale WHERE stale.gr = w.gr AND stale.doc_type = w.doc_type) THEN 2 ELSE 1 END AS tier, 'add' AS what FROM w
      WHERE t IS NOT NULL AND NOT EXISTS (SELECT 1 FROM e WHERE e.edge_type = 'supersedes' AND e.source_id = w.s AND e.target_id = w.t)""", D, E),
    "q17_2_code_matches": with_tables("""c AS (SELECT id, doc_type, n % 3 = 0 AS new, unnest(list_distinct(['C' || n % 40, 'C' || n % 25])) AS code FROM d)
      SELECT DISTINCT a.id AS source_id, b.id AS target_id, 2 AS tier FROM c a JOIN c b USING (code) WHERE a.doc_type IN ('note', 'memo') AND b.doc_type NOT IN ('note', 'memo') AND (a.new OR b.new)""", D),
    "q17_4_mentions": with_tables("""b AS (SELECT k, id FROM (SELECT n % 50 AS k, id, row_number() OVER (PARTITION BY n % 50 ORDER BY lifecycle_status NOT IN ('active', 'completed'), updated_at DESC, id) AS r FROM d) WHERE r = 1),
      m AS (SELECT id, unnest([n * 3 % 50, n % 50]) AS k FROM d) SELECT DISTINCT m.id AS source_id, b.id AS target_id FROM m JOIN b USING (k) WHERE m.id <> b.id""", D),
    "q17_5_reconcile": with_tables("""pl AS (SELECT source_id, target_id FROM e WHERE edge_type = 'references' AND CAST(substr(source_id, 2) AS INTEGER) % 3 = 0 UNION ALL SELECT id, id FROM d)
      SELECT source_id, target_id, 'delete' AS what FROM e WHERE edge_type = 'references' AND rationale LIKE 'inferred:%' AND CAST(substr(source_id, 2) AS INTEGER) % 3 <> 0 UNION ALL SELECT id, id, 'create' FROM d""", D, E),
    "q17_8_source_audit": with_tables("SELECT id, CASE n % 6 WHEN 0 THEN 'out_of_root' WHEN 1 THEN 'symlinked' WHEN 2 THEN 'out_of_root' WHEN 3 THEN 'healthy' WHEN 4 THEN 'hash_mismatch' ELSE 'missing' END AS verdict FROM d", D),
    "q17_22_paths": with_tables("SELECT id, source_path AS before, replace(source_path, '/./', '/') AS after, CAST(0 AS BIGINT) AS others FROM d WHERE source_path LIKE '%/./%'", D),
    "q17_11_purge": with_tables("""x AS (SELECT source_id AS id FROM e WHERE edge_type = 'derived_from' UNION SELECT target_id FROM e WHERE edge_type = 'derived_from')
      SELECT id, CASE WHEN id IN (SELECT id FROM x) THEN 'pending_staging_edge' WHEN lifecycle_status NOT IN ('archived', 'completed') THEN 'non_terminal_status' END AS refusal FROM d WHERE created_at >= '2024-01-02T00:00:00' AND created_at < '2024-01-20T00:00:00'""", D, E),
    "q17_12_discovery": with_tables("""f AS (SELECT doc_type AS region, CAST(section_index AS VARCHAR) AS field, content AS text, count(*) AS copies FROM p JOIN d ON d.id = document_id GROUP BY ALL)
      SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY region, field ORDER BY sha256(text), text) AS INTEGER) AS turn FROM f) WHERE turn <= 5""", D, P),
    "q17_15_resolved_hashes": with_tables("""a AS (SELECT DISTINCT CASE WHEN n % 9 = 8 THEN 'zz' || n ELSE substr(source_content_hash, 1, 3 + n % 5) END AS abbreviation FROM d), h AS (SELECT DISTINCT source_content_hash AS hash FROM d),
      m AS (SELECT abbreviation, count(hash) AS matches, min(hash) AS one FROM a LEFT JOIN h ON length(abbreviation) >= 4 AND starts_with(hash, abbreviation) GROUP BY 1)
      SELECT abbreviation, CASE WHEN length(abbreviation) < 4 THEN 'too_short' WHEN matches = 1 THEN 'resolved' WHEN matches > 1 THEN 'ambiguous' ELSE 'unknown' END AS status, CASE WHEN matches = 1 THEN one END AS hash, matches FROM m""", D),
    "q17_12_selection": with_tables("""f AS (SELECT document_id AS source, content AS text, min(chunk_index) AS place, arg_min(heading_path, chunk_index) AS region, len(regexp_extract_all(content, '[^ ]+')) AS tokens, count(*) AS repetitions FROM p WHERE trim(content) <> '' GROUP BY 1, 2),
      a AS (SELECT *, row_number() OVER (PARTITION BY source, region ORDER BY place, text) - 1 AS pos, count(*) OVER (PARTITION BY source, region) AS size, count(*) OVER (PARTITION BY source) <= 6 AND sum(tokens) OVER (PARTITION BY source) <= 90 AS fits FROM f),
      s AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY pos, region) AS slot FROM a WHERE NOT fits),
      gr AS (SELECT source, region, count(*) FILTER (slot <= 6) AS slots, any_value(size) AS size, 90 // (count(*) OVER (PARTITION BY source)) AS share FROM s GROUP BY 1, 2),
      ch AS (SELECT source, region, share, CASE WHEN slots >= size THEN i WHEN slots = 1 THEN size // 2 ELSE i * (size - 1) // (slots - 1) END AS pos, i FROM (SELECT *, unnest(range(0, slots)) AS i FROM gr WHERE slots > 0)),
      q AS (SELECT ch.*, tokens, row_number() OVER (PARTITION BY source, region ORDER BY pos) AS k FROM ch JOIN a USING (source, region, pos)),
      own AS (
        SELECT source, region, pos, k, tokens, tokens <= share AS kept, CASE WHEN tokens <= share THEN tokens ELSE 0 END AS spent FROM q WHERE k = 1
        UNION ALL SELECT q.source, q.region, q.pos, q.k, q.tokens, q.tokens <= share - spent, spent + CASE WHEN q.tokens <= share - spent THEN q.tokens ELSE 0 END FROM own JOIN q ON q.source = own.source AND q.region = own.region AND q.k = own.k + 1),
      rest AS (SELECT source, 90 - coalesce(sum(tokens) FILTER (kept), 0) AS budget FROM own GROUP BY 1),
      pend AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY region, pos) AS j FROM own JOIN rest USING (source) WHERE NOT kept),
      more AS (
        SELECT source, region, pos, j, tokens <= budget AS kept, budget - CASE WHEN tokens <= budget THEN tokens ELSE 0 END AS budget FROM pend WHERE j = 1
        UNION ALL SELECT p2.source, p2.region, p2.pos, p2.j, p2.tokens <= more.budget, more.budget - CASE WHEN p2.tokens <= more.budget THEN p2.tokens ELSE 0 END FROM more JOIN pend p2 ON p2.source = more.source AND p2.j = more.j + 1),
      sel AS (SELECT source, region, pos FROM own WHERE kept UNION ALL SELECT source, region, pos FROM more WHERE kept)
      SELECT source, region, place, tokens, repetitions, md5(text) AS digest, '' AS limits FROM a WHERE fits
      UNION ALL SELECT source, region, place, tokens, repetitions, md5(text), 'selection_budget' FROM a JOIN sel USING (source, region, pos)""", P),
    "q17_15_failures": """WITH c AS (SELECT event_type AS kind, user_id AS cause, count(*) AS n FROM events GROUP BY ALL)
      SELECT kind, CAST(sum(n) AS BIGINT) AS failures, count(*) AS causes, round(sum(CASE WHEN n > 1 THEN n ELSE 0 END) / sum(n), 9) AS recurrence FROM c GROUP BY 1""",
}
