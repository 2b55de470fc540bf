"""Browse, filter, facet, count and lookup queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import browse, filters
from ..plans.oracle_tables import D, E, P, with_tables
from ..sources import graph_tables as g

FIELDS = ("document_date", "lifecycle_status", "semantic_abstract")
_TOP = "SELECT * FROM (SELECT {cols}, CAST(row_number() OVER (ORDER BY {keys}) AS INTEGER) AS rank FROM d WHERE {where}) WHERE rank > {low} AND rank <= {high}"


def _page(spark, sf_dir, **request):
    page = browse.browse(g.documents(spark, sf_dir), **request)
    return page.select("id", "title", "document_date", "lifecycle_status", "rank", "total_count")


def _sql_page(keys, where="TRUE", low=0, high=50):
    inner = _TOP.format(cols="id, title, document_date, lifecycle_status", keys=keys, where=where, low=low, high=high)
    return with_tables(f"t AS (SELECT count(*) AS total_count FROM d WHERE {where}) SELECT * FROM ({inner}), t", D)


def q12_1_facets(spark, sf_dir):
    return browse.facets(g.documents(spark, sf_dir), value_limit=20)


def q12_2_facets_tags(spark, sf_dir):
    return browse.facets(g.documents(spark, sf_dir), {"lifecycle_status": "archived"}, fields=("tags",), value_limit=None)


def q12_3_facets_tier3(spark, sf_dir):
    return browse.facets(g.documents(spark, sf_dir), fields=(), tier3=("sev", "owner"), value_limit=None)


def q12_3_absent(spark, sf_dir):
    return browse.absent_counts(g.documents(spark, sf_dir), ("sev", "owner"))


def q9_1_browse_default(spark, sf_dir):
    return _page(spark, sf_dir, limit=50)


def q9_2_browse_date(spark, sf_dir):
    return _page(spark, sf_dir, limit=50, sort_by="document_date", order="asc")


def q9_5_browse_page(spark, sf_dir):
    return _page(spark, sf_dir, filters={"doc_type": "report", "exclude_lifecycle": ["archived"]}, limit=20, offset=20, sort_by="title", order="desc")


def q9_3_browse_tier3(spark, sf_dir):
    docs = g.documents(spark, sf_dir).where("""tier3 not like '%"sev":"%' and tier3 not like '%"sev":[%'""")  # numbers and what has none
    return browse.browse(docs, limit=100, sort_by="tier3:sev", order="desc").select("id", "rank")


def q4_1_default_visible(spark, sf_dir):
    return g.documents(spark, sf_dir).where(filters.document_filter({}, exclude_failed=True)).select("id", "pipeline_status", "projection_scope")


def q4_3_authoritative(spark, sf_dir):
    return g.documents(spark, sf_dir).where(filters.document_filter({"authority": True})).select("id", "authority_scope")


def q4_6_all_tags(spark, sf_dir):
    return g.documents(spark, sf_dir).where(filters.document_filter({"tags": ["en", "pv3"]})).select("id", "title")


def q4_7_provenance(spark, sf_dir):
    wanted = {"created_by": ["u1", "u3"], "created_by_name": None}
    return g.documents(spark, sf_dir).where(filters.document_filter({"provenance": wanted})).select("id", "created_by")


def q4_9_tier3_number(spark, sf_dir):
    return g.documents(spark, sf_dir).where(filters.document_filter({"tier3": {"sev": 1}})).select("id", "tier3")


def q4_9_tier3_text(spark, sf_dir):
    return g.documents(spark, sf_dir).where(filters.document_filter({"tier3": {"sev": "2"}})).select("id", "tier3")


def q4_10_tier3_none(spark, sf_dir):
    return g.documents(spark, sf_dir).where(filters.tier3_list("sev", none=["x"], doc_types=["report", "note"])).select("id", "doc_type")


def q4_10_tier3_contains(spark, sf_dir):
    return g.documents(spark, sf_dir).where(filters.tier3_list("sev", contains=3, all=["x"])).select("id", "tier3")


def q4_17_substring(spark, sf_dir):
    return g.documents(spark, sf_dir).where(filters.contains_text(F.col("title"), "EN_part")).select("id", "title")


def q4_18_non_canonical(spark, sf_dir):
    return g.documents(spark, sf_dir).where(filters.not_plain(F.col("source_path"))).select("id", "source_path")


def q4_19_heading_prefix(spark, sf_dir):
    docs = g.passages(spark, sf_dir)
    return docs.where(filters.under_heading("Src0-en_PartNo0") & (F.col("chunk_index") >= 0)).select("document_id", "chunk_index", "heading_path")


def q4_20_ingested_between(spark, sf_dir):
    return filters.ingested_between(g.documents(spark, sf_dir), "2024-01-02T00:00:00", "2024-01-20T00:00:00").select("id", "created_at")


def q4_21_long_passages(spark, sf_dir):
    return filters.longer_than(g.passages(spark, sf_dir), 900)


def q4_22_pending(spark, sf_dir):
    return filters.pending_metadata(g.documents(spark, sf_dir), ["archived"], limit=25).select("id", "title")


def q4_23_title(spark, sf_dir):
    return g.documents(spark, sf_dir).where(F.lower("title") == "src3-en_partno3").select("id", "title")


def q12_5_counts(spark, sf_dir):
    return browse.counts_by(g.documents(spark, sf_dir), "pipeline_status")


def q12_9_principals(spark, sf_dir):
    return browse.principal_names(g.documents(spark, sf_dir), g.edges(spark, sf_dir))


def q4_8_nearest_by_ratio(spark, sf_dir):
    return browse.nearest_names_by_ratio(browse.principal_names(g.documents(spark, sf_dir), g.edges(spark, sf_dir)), "Usr 3")


def q4_8_nearest_names(spark, sf_dir):
    return browse.nearest_names(browse.principal_names(g.documents(spark, sf_dir), g.edges(spark, sf_dir)), "Usr 3")


def q12_10_stats(spark, sf_dir):
    return browse.vault_stats(g.documents(spark, sf_dir), g.edges(spark, sf_dir))


def q10_7_duplicates(spark, sf_dir):
    docs = g.documents(spark, sf_dir)
    wanted = docs.select(F.col("source_content_hash").alias("hash")).unionByName(docs.select(F.sha2("id", 256).alias("hash")))
    return browse.by_hashes(docs, wanted, ("active", "completed"))


def q12_12_ids_by_path(spark, sf_dir):
    return browse.ids_by_path(g.documents(spark, sf_dir))


def q3_7_metadata_changes(spark, sf_dir):
    docs = g.documents(spark, sf_dir)
    after = docs.withColumn("lifecycle_status", F.when(F.col("n") % 5 == 0, "archived").otherwise(F.col("lifecycle_status"))).withColumn("document_date", F.when(F.col("n") % 3 != 1, F.col("document_date")))
    return browse.metadata_changes(docs, after, ("document_date", "lifecycle_status"))


def q3_1_light(spark, sf_dir):
    return browse.light(g.documents(spark, sf_dir))


def q2_19_views(spark, sf_dir):
    return browse.views(g.documents(spark, sf_dir))


QUERIES = {k: v for k, v in list(globals().items()) if k.startswith("q") and callable(v)}

_FACET = """c AS ({arms}), k AS (SELECT field, value, count(*) AS doc_count FROM c WHERE value IS NOT NULL GROUP BY ALL)
  SELECT field, value, doc_count, total_distinct FROM (
    SELECT *, row_number() OVER (PARTITION BY field ORDER BY doc_count DESC, value) AS r, count(*) OVER (PARTITION BY field) AS total_distinct FROM k) WHERE r <= {most}"""
_SEV = "json_type(tier3, '$.sev')"

ORACLE = {
    "q12_1_facets": with_tables(_FACET.format(arms=" UNION ALL ".join(f"SELECT '{f}' AS field, {f} AS value FROM d" for f in browse.FACETS), most=20), D),
    "q12_2_facets_tags": with_tables(_FACET.format(arms="SELECT 'tags' AS field, unnest(list_distinct(tags)) AS value FROM d WHERE lifecycle_status = 'archived'", most=10**9), D),
    "q12_3_facets_tier3": with_tables(
        _FACET.format(arms="""SELECT 'tier3:owner' AS field, tier3 ->> '$.owner' AS value FROM d UNION ALL
          SELECT 'tier3:sev', CAST(n % 4 AS VARCHAR) FROM d WHERE n % 6 < 4 UNION ALL SELECT 'tier3:sev', 'x' FROM d WHERE n % 6 = 3""", most=10**9), D),
    "q12_3_absent": with_tables("SELECT unnest(['sev', 'owner']) AS field, unnest([(SELECT count(*) FROM d WHERE tier3 ->> '$.sev' IS NULL), (SELECT count(*) FROM d WHERE tier3 ->> '$.owner' IS NULL)]) AS absent_count", D),
    "q9_1_browse_default": _sql_page("CASE WHEN lifecycle_status = 'active' THEN 0 ELSE 1 END, document_date IS NULL, document_date DESC NULLS LAST, id"),
    "q9_2_browse_date": _sql_page("document_date IS NULL, document_date ASC NULLS LAST, id"),
    "q9_5_browse_page": _sql_page("title DESC NULLS FIRST, id", "doc_type = 'report' AND lifecycle_status <> 'archived'", 20, 40),
    "q9_3_browse_tier3": with_tables("""s AS (SELECT id, CAST(tier3 ->> '$.sev' AS DOUBLE) AS v FROM d WHERE coalesce(json_type(tier3, '$.sev'), 'NULL') NOT IN ('VARCHAR', 'ARRAY'))
      SELECT id, CAST(rank AS INTEGER) AS rank FROM (SELECT id, row_number() OVER (ORDER BY v IS NULL, v DESC NULLS LAST, id) AS rank FROM s) WHERE rank <= 100""", D),
    "q4_1_default_visible": with_tables("SELECT id, pipeline_status, projection_scope FROM d WHERE pipeline_status <> 'failed' OR projection_scope IN ('limited', 'complete')", D),
    "q4_3_authoritative": with_tables("SELECT id, authority_scope FROM d WHERE authority_scope IS NOT NULL AND authority_scope <> ''", D),
    "q4_6_all_tags": with_tables("SELECT id, title FROM d WHERE list_contains(tags, 'en') AND list_contains(tags, 'pv3')", D),
    "q4_7_provenance": with_tables("SELECT id, created_by FROM d WHERE created_by IN ('u1', 'u3') AND created_by_name IS NULL", D),
    "q4_9_tier3_number": with_tables(f"SELECT id, tier3 FROM d WHERE {_SEV} IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND TRY_CAST(tier3 ->> '$.sev' AS DOUBLE) = 1", D),
    "q4_9_tier3_text": with_tables("SELECT id, tier3 FROM d WHERE tier3 ->> '$.sev' = '2'", D),
    "q4_10_tier3_none": with_tables("SELECT id, doc_type FROM d WHERE doc_type IN ('report', 'note') AND NOT coalesce(json_contains(tier3 -> '$.sev', '\"x\"'), FALSE)", D),
    "q4_10_tier3_contains": with_tables("SELECT id, tier3 FROM d WHERE json_type(tier3, '$.sev') = 'ARRAY' AND json_contains(tier3 -> '$.sev', '3') AND json_contains(tier3 -> '$.sev', '\"x\"')", D),
    "q4_17_substring": with_tables("SELECT id, title FROM d WHERE title ILIKE '%EN\\_part%' ESCAPE '\\'", D),
    "q4_18_non_canonical": with_tables("SELECT id, source_path FROM d WHERE regexp_matches(source_path, '(^|/)[.](/|$)|//|/$')", D),
    "q4_19_heading_prefix": with_tables("SELECT document_id, chunk_index, heading_path FROM p WHERE heading_path = 'Src0-en_PartNo0' OR starts_with(heading_path, 'Src0-en_PartNo0 > ')", P),
    "q4_20_ingested_between": with_tables("SELECT id, created_at FROM d WHERE created_at >= '2024-01-02T00:00:00' AND created_at < '2024-01-20T00:00:00'", D),
    "q4_21_long_passages": with_tables("SELECT DISTINCT document_id FROM p WHERE strlen(heading_path) + strlen(content) > 900", P),
    "q4_22_pending": with_tables("SELECT id, title FROM d WHERE NOT metadata_confirmed AND lifecycle_status <> 'archived' ORDER BY id LIMIT 25", D),
    "q4_23_title": with_tables("SELECT id, title FROM d WHERE lower(title) = 'src3-en_partno3'", D),
    "q12_5_counts": with_tables("SELECT pipeline_status AS value, count(*) AS doc_count FROM d GROUP BY 1", D),
    "q12_9_principals": with_tables("""a AS (SELECT created_by AS key, created_by_name AS name, created_at AS made FROM d UNION ALL SELECT last_modified_by, last_modified_by_name, updated_at FROM d UNION ALL SELECT created_by, created_by_name, created_at FROM e)
      SELECT key, name FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY name IS NULL, made DESC, name DESC) AS r FROM a) WHERE r = 1""", D, E),
    "q4_8_nearest_names": with_tables("""a AS (SELECT created_by AS key, created_by_name AS name, created_at AS made FROM d UNION ALL SELECT last_modified_by, last_modified_by_name, updated_at FROM d UNION ALL SELECT created_by, created_by_name, created_at FROM e),
      b AS (SELECT DISTINCT name FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY name IS NULL, made DESC, name DESC) AS r FROM a) WHERE r = 1 AND name IS NOT NULL)
      SELECT name, CAST(levenshtein(lower(name), 'usr 3') AS INTEGER) AS distance FROM b ORDER BY 2, 1 LIMIT 3""", D, E),
    "q12_10_stats": with_tables("""s AS (SELECT count(*) AS documents, max(created_at) AS last_ingestion_at, count(*) FILTER (lifecycle_status <> 'archived' AND pipeline_status = 'failed') AS failed,
        count(*) FILTER (lifecycle_status <> 'archived' AND pipeline_status = 'abstraction_skipped') AS abstraction_skipped, count(*) FILTER (lifecycle_status <> 'archived' AND NOT metadata_confirmed) AS pending_metadata FROM d),
      x AS (SELECT count(*) AS edges, count(*) FILTER (edge_type = 'retracts') AS retractions FROM e)
      SELECT unnest(['documents', 'last_ingestion_at', 'failed', 'abstraction_skipped', 'pending_metadata', 'edges', 'retractions']) AS name,
        unnest([CAST(documents AS VARCHAR), last_ingestion_at, CAST(failed AS VARCHAR), CAST(abstraction_skipped AS VARCHAR), CAST(pending_metadata AS VARCHAR), CAST(edges AS VARCHAR), CAST(retractions AS VARCHAR)]) AS value FROM s, x""", D, E),
    "q10_7_duplicates": with_tables("""a AS (SELECT source_content_hash AS hash, id, lifecycle_status, 0 AS arm FROM d UNION ALL SELECT stored_content_hash, id, lifecycle_status, 1 FROM d),
      b AS (SELECT hash, id FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY lifecycle_status NOT IN ('active', 'completed'), arm, id) AS r FROM a) WHERE r = 1),
      h AS (SELECT source_content_hash AS hash FROM d UNION SELECT sha256(id) FROM d)
      SELECT hash, b.id IS NOT NULL AS exists, b.id AS document_id FROM h LEFT JOIN b USING (hash)""", D),
    "q12_12_ids_by_path": with_tables("SELECT source_path, string_agg(id, ',' ORDER BY id) AS ids, count(*) AS n FROM d GROUP BY 1", D),
    "q3_7_metadata_changes": with_tables("""a AS (SELECT id, CASE WHEN n % 5 = 0 THEN 'archived' ELSE lifecycle_status END AS l, lifecycle_status AS l0, CASE WHEN n % 3 <> 1 THEN document_date END AS t, document_date AS t0 FROM d)
      SELECT id, 'document_date' AS field, t0 AS before, t AS after FROM a WHERE t IS DISTINCT FROM t0 UNION ALL SELECT id, 'lifecycle_status', l0, l FROM a WHERE l IS DISTINCT FROM l0""", D),
    "q3_1_light": with_tables("SELECT id, title, lifecycle_status, doc_type, tier3, projection_scope FROM d", D),
    "q2_19_views": with_tables("""s AS (SELECT id, regexp_replace(lower(title), '[^a-z0-9]+', '_', 'g') AS stem, doc_type, lifecycle_status FROM d),
      u AS (SELECT id, stem, 'doc_type' AS view, doc_type AS value FROM s UNION ALL SELECT id, stem, 'lifecycle', lifecycle_status FROM s),
      r AS (SELECT *, row_number() OVER (PARTITION BY view, value, stem ORDER BY id) AS k FROM u)
      SELECT id, view, value, CASE WHEN k = 1 THEN stem ELSE stem || '_' || k END AS file FROM r""", D),
}
