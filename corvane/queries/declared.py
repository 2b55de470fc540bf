"""Queries of declared fields, delivery and publication."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import declared, filters
from ..plans.oracle_tables import D, P, with_tables
from ..sources import graph_tables as g

SCHEMA = {
    "owner": {"type": "string"}, "sev": {"type": ["integer", "null"]}, "labels": {"type": "array", "items": {"type": "string", "enum": ["a", "b"]}}, "parts": {"type": "array", "items": {"type": "object"}}, "who": {"$ref": "#/person"},
    "person": {"type": "object"}, "either": {"anyOf": [{"type": "string"}, {"type": "null"}]}, "any": {"oneOf": [{"type": "string"}, {"type": "object"}]}, "kind": {"enum": ["x", 1]}, "free": {},
}


def q4_11_field_kinds(spark, sf_dir):
    return spark.createDataFrame([(k, declared.field_kind(s, SCHEMA)) for k, s in SCHEMA.items()], "field string, kind string")


def q10_11_admission(spark, sf_dir):
    rows = [(f, str(v), declared.admits(SCHEMA[f], v)) for f, v in (("owner", "x"), ("owner", 1), ("sev", 2), ("sev", None), ("sev", True), ("sev", 2.5), ("labels", "a"), ("labels", "c"), ("kind", "x"), ("kind", "y"))]
    return spark.createDataFrame(rows, "field string, value string, admitted boolean")


def q4_12_key_fence(spark, sf_dir):
    return declared.undeclared_keys(g.documents(spark, sf_dir), {"report": ["owner"], "note": ["sev", "owner"], "memo": ["sev"]})


def q4_13_pushdown(spark, sf_dir):
    docs, passages = g.documents(spark, sf_dir), g.passages(spark, sf_dir)
    kept = declared.filtered_passages(passages, docs, filters.document_filter({"doc_type": "note"}) & F.col("project").isin("proj1", "proj2"))
    return kept.groupBy("document_id").agg(F.count("*").alias("passages"))


def q1_18_delivery(spark, sf_dir):
    docs = g.documents(spark, sf_dir).withColumn("source_path", F.when(F.col("doc_type") == "memo", F.concat("source_path", F.lit(".pdf"))).otherwise(F.col("source_path")))
    return declared.delivery(docs, 1_000).select("id", "mode", F.md5("content").alias("digest"))


def q2_12_rederive(spark, sf_dir):
    passages = g.passages(spark, sf_dir).withColumn("structure", F.when(F.col("section_index") % 2 == 0, F.lit("S0")))
    derived = passages.where("section_index < 2").select("document_id", "heading_path", F.concat(F.lit("S"), F.col("section_index").cast("string")).alias("structure"))
    after, changed = declared.rederived(passages, derived)
    return after.groupBy("document_id").agg(F.count("structure").alias("held")).join(changed, "document_id", "left")


def q2_14_admission(spark, sf_dir):
    rows = g.passages(spark, sf_dir).select("document_id", F.col("chunk_index").alias("place"), F.length("content").alias("tokens"))
    return declared.admitted(rows, 1_500, 8)


def q2_15_publish(spark, sf_dir):
    docs = g.documents(spark, sf_dir).select("id", (F.col("n") % 3).alias("attempt"), F.col("title").alias("abstract"), "doc_type")
    results = docs.select("id", F.lit(1).alias("attempt"), F.concat(F.lit("one "), "id").alias("abstract")).unionByName(docs.select("id", F.lit(2).alias("attempt"), F.lit("two").alias("abstract")))
    return declared.published(docs, results)


def q17_13_inspection(spark, sf_dir):
    docs = g.documents(spark, sf_dir)
    evidence = docs.select(F.col("id").alias("document_id"), (F.col("n") % 4).alias("generation"), F.when(F.col("metadata_confirmed"), F.col("source_content_hash")).otherwise("old").alias("hash"))
    latest = docs.where("doc_type <> 'memo'").select(F.col("id").alias("document_id"), F.lit(2).alias("latest"), F.col("source_content_hash").alias("source_hash"))
    return declared.inspected(evidence, latest)


def q17_20_preambles(spark, sf_dir):
    docs = g.documents(spark, sf_dir)
    sections = docs.select(F.col("id").alias("document_id"), F.lit(0).alias("section"), F.col("title").alias("content"))
    passages = docs.where("doc_type = 'note'").select(F.col("id").alias("document_id"), F.lit("").alias("heading_path")).unionByName(g.passages(spark, sf_dir).select("document_id", "heading_path"))
    return declared.missing_preambles(sections, passages)


def q17_23_observations(spark, sf_dir):
    docs = g.documents(spark, sf_dir)
    files = docs.where("doc_type <> 'memo'").groupBy(F.col("source_path").alias("path")).agg(F.max("source_content_hash").alias("hash"), F.max("doc_type").alias("t"))
    seen = files.select("path", "hash", F.when(F.col("t") == "note", F.concat(F.lit("/elsewhere/"), "path")).otherwise(F.col("path")).alias("resolved"))
    return declared.observed(docs, seen, "vault")


QUERIES = {n: f for n, f in list(globals().items()) if n.startswith("q") and callable(f)}

ORACLE = {
    "q4_11_field_kinds": """SELECT * FROM (VALUES ('owner', 'scalar'), ('sev', 'scalar'), ('labels', 'array'), ('parts', 'composite'), ('who', 'object'), ('person', 'object'), ('either', 'scalar'), ('any', 'mixed'), ('kind', 'scalar'), ('free', 'mixed')) t(field, kind)""",
    "q10_11_admission": """SELECT * FROM (VALUES ('owner', 'x', TRUE), ('owner', '1', FALSE), ('sev', '2', TRUE), ('sev', 'None', TRUE), ('sev', 'True', FALSE), ('sev', '2.5', FALSE), ('labels', 'a', TRUE), ('labels', 'c', FALSE), ('kind', 'x', TRUE), ('kind', 'y', FALSE)) t(field, value, admitted)""",
    "q4_12_key_fence": with_tables("""k AS (SELECT doc_type, unnest(json_keys(tier3)) AS key FROM d) SELECT doc_type, key, 'undeclared' AS problem, count(*) AS documents FROM k
      WHERE doc_type || '.' || key NOT IN ('report.owner', 'note.sev', 'note.owner', 'memo.sev') GROUP BY ALL""", D),
    "q4_13_pushdown": with_tables("SELECT document_id, count(*) AS passages FROM p WHERE document_id IN (SELECT id FROM d WHERE doc_type = 'note' AND project IN ('proj1', 'proj2')) GROUP BY 1", D, P),
    "q1_18_delivery": with_tables("""SELECT id, CASE WHEN doc_type <> 'memo' AND strlen(text) <= 1000 THEN 'inline' ELSE 'path' END AS mode,
      md5(CASE WHEN doc_type = 'memo' THEN source_path || '.pdf' WHEN strlen(text) <= 1000 THEN text ELSE source_path END) AS digest FROM d""", D),
    "q2_12_rederive": with_tables("""SELECT document_id, count(*) FILTER (section_index < 2 OR section_index % 2 = 0) AS held, nullif(count(*) FILTER (section_index = 1), 0) AS changed FROM p GROUP BY 1""", P),
    "q2_14_admission": with_tables("""x AS (SELECT document_id, chunk_index AS place, length(content) AS tokens, sum(length(content)) OVER w AS used, count(*) OVER w AS c FROM p WINDOW w AS (PARTITION BY document_id ORDER BY chunk_index))
      SELECT document_id, place, tokens, CAST(used AS BIGINT) AS used, used <= 1500 AND c <= 8 AS admitted FROM x""", P),
    "q2_15_publish": with_tables("SELECT id, n % 3 AS attempt, CASE n % 3 WHEN 1 THEN 'one ' || id WHEN 2 THEN 'two' ELSE title END AS abstract, n % 3 <> 0 AS published FROM d", D),
    "q17_13_inspection": with_tables("SELECT id AS document_id, n % 4 AS generation, doc_type <> 'memo' AND n % 4 = 2 AND metadata_confirmed AS current FROM d", D),
    "q17_20_preambles": with_tables("SELECT id AS document_id, title AS content FROM d WHERE doc_type <> 'note'", D),
    "q17_23_observations": with_tables("""f AS (SELECT source_path AS path, max(source_content_hash) AS hash, max(doc_type) AS t FROM d WHERE doc_type <> 'memo' GROUP BY 1)
      SELECT id, f.path IS NOT NULL AS present, coalesce(t = 'note', FALSE) AS symlink, coalesce(t = 'note', FALSE) AS out_of_root, hash = source_content_hash AS same_hash FROM d LEFT JOIN f ON f.path = source_path""", D),
}
