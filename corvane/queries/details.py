"""Queries of smaller operators: point reads, gates, text functions, traces, verdicts of evaluations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import browse, chain_order, changes, evaluation, filters, graph, inference, lifecycle
from ..plans.oracle_tables import D, E, P, with_tables
from ..sources import graph_tables as g
from .graph import _BREADTH, _COMP, _FAM, _SHAPE, _SUP


def q1_15_point_lookups(spark, sf_dir):
    """The source of every edge, looked up by id."""
    docs, edges = g.documents(spark, sf_dir), g.edges(spark, sf_dir)
    return edges.select(F.col("id").alias("edge_id"), F.col("source_id").alias("id")).join(docs.select("id", "title", "lifecycle_status"), "id")


def q3_3_hydration(spark, sf_dir):
    """Documents reached at depth one, with their own columns and the number of edges to them."""
    docs, edges = g.documents(spark, sf_dir), g.edges(spark, sf_dir)
    found = graph.nodes(graph.traverse(edges, docs.select("id"), "outbound", depth=1))
    return found.join(docs.select(F.col("id").alias("document_id"), "title"), "document_id").select("start_id", "document_id", "title", "depth", "edge_count")


def q3_2_edge_counts(spark, sf_dir):
    docs, edges = g.documents(spark, sf_dir), g.edges(spark, sf_dir)
    return graph.edge_counts(graph.traverse(edges, docs.select("id"), "outbound", depth=1))


def q3_5_excerpts(spark, sf_dir):
    return browse.excerpts(g.passages(spark, sf_dir), 80).select("document_id", "chunk_index", "content", "cut")


def q3_6_budget_fit(spark, sf_dir):
    """The first documents by id whose JSON fits 45,000 bytes."""
    page = g.documents(spark, sf_dir).select("id", "title", "doc_type").orderBy("id").limit(1_000)
    return browse.fitting_prefix(page, 45_000, "id").select("id", "bytes")


def q4_5_id_list(spark, sf_dir):
    ids = [g_id for (g_id,) in (("d00000003",), ("d00000019",), ("nobody",))]
    return g.documents(spark, sf_dir).where(filters.in_scope("specific", ids)).select("id", "title")


def q4_14_scopes(spark, sf_dir):
    docs = g.documents(spark, sf_dir)
    gate = {"all": filters.in_scope("all"), "authoritative": filters.in_scope("authoritative"), "filtered": filters.in_scope("filtered", filters={"doc_type": "note"})}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("scope"), c.alias("inside")) for k, c in gate.items()]))
    return docs.select("id", each.alias("s")).where("s.inside").groupBy("s.scope").agg(F.count("*").alias("documents"))


def q4_16_threshold(spark, sf_dir):
    """Documents scored by the share of good words; the failed ones are not scored and stay."""
    scored = g.documents(spark, sf_dir).select("id", F.when(F.col("pipeline_status") != "failed", F.col("n") % 100 / 100).alias("score"))
    return scored.where(filters.relevant(0.35))


def q4_8_resolved(spark, sf_dir):
    return browse.resolve_principals(browse.principal_names(g.documents(spark, sf_dir), g.edges(spark, sf_dir)), "user 3")


def q8_17_resolution_trace(spark, sf_dir):
    docs, edges = g.documents(spark, sf_dir).drop("text", "semantic_abstract"), g.edges(spark, sf_dir)
    return graph.resolution_trace(docs, edges, docs.select("id"))


def q8_18_head_first(spark, sf_dir):
    """Every document with its turn in the purge of its chain, by position from the newest."""
    docs, edges = g.documents(spark, sf_dir).drop("text", "semantic_abstract"), g.edges(spark, sf_dir)
    placed = chain_order.chain_order(docs, edges)
    return changes.head_first(docs, placed.select("id", "chain", (F.col("length") - 1 - F.col("position")).alias("depth")))


def q9_9_row_cap(spark, sf_dir):
    docs, edges = g.documents(spark, sf_dir), g.edges(spark, sf_dir)
    steps = graph.traverse(edges, docs.select("id"), "both", depth=1)
    return graph.capped(steps.select("start_id", "id", "to_id"), 10_000, "start_id", "id", "to_id")


def q10_3_state_sets(spark, sf_dir):
    """Documents by whether their state has a way out and whether it survives a supersession."""
    docs = g.documents(spark, sf_dir)
    flags = F.col("lifecycle_status").isin(*lifecycle.terminal_states()).alias("terminal"), F.col("lifecycle_status").isin(*lifecycle.supersession_surviving()).alias("surviving")
    return docs.groupBy("lifecycle_status", *flags).agg(F.count("*").alias("documents"))


def q10_1_apply_lifecycle(spark, sf_dir):
    docs = g.documents(spark, sf_dir)
    wanted = docs.select("id", F.when(F.col("doc_type") == "note", "archive").when(F.col("doc_type") == "memo", "reactivate").otherwise("complete").alias("action"))
    return lifecycle.apply_lifecycle(docs, lifecycle.set_lifecycle(docs, wanted, lifecycle.transitions(spark))).select("id", "lifecycle_status")


def q13_8_embedding_input(spark, sf_dir):
    return g.passages(spark, sf_dir).select("document_id", "chunk_index", F.md5(t.embedding_input(F.col("heading_path"), F.col("content"))).alias("digest"))


def q13_11_versions(spark, sf_dir):
    docs = g.documents(spark, sf_dir)
    version = F.concat(F.lit("v"), (F.col("n") % 12).cast("string"), F.when(F.col("n") % 3 != 0, F.concat(F.lit("_"), (F.col("n") % 5).cast("string"))).otherwise(""), F.when(F.col("n") % 3 == 2, "_7").otherwise(""))
    parts = t.version_parts(version)
    return docs.select("id", version.alias("version"), parts["major"].alias("major"), parts["minor"].alias("minor"), parts["patch"].alias("patch"), t.format_version(version).alias("shown"))


def q13_13_markup(spark, sf_dir):
    return g.table(spark, sf_dir, "pages").select("page_id", F.md5(t.neutral_markup(F.col("html"))).alias("digest"))


def q13_18_structure_echo(spark, sf_dir):
    """Structure found in the lines of every conversation's turns, written as a list under a heading."""
    turns = g.table(spark, sf_dir, "conversations").where("text is not null")
    flat = F.regexp_replace("text", "\\s+", " ")
    text = F.concat(F.lit("# "), "role", F.lit("\n- one "), flat, F.lit("\n- two\nplain"))
    found = turns.select("conv_id", "turn", F.explode(t.structure_echo(text)).alias("f"))
    return found.select("conv_id", "turn", F.col("f.line").alias("line"), F.col("f.kind").alias("kind"))


def q13_22_token_budget(spark, sf_dir):
    docs = g.documents(spark, sf_dir)
    words = F.size(F.filter(F.split("text", " "), lambda w: w != ""))
    return docs.select("id", t.token_budget(words).alias("budget"))


def q13_23_cids(spark, sf_dir):
    text = F.concat(F.lit("(cid:"), (F.col("n") % 140).cast("string"), F.lit(")x(cid:7)"), "title")
    return g.documents(spark, sf_dir).select("id", t.readable_cids(text).alias("text"))


def q13_12_well_formed(spark, sf_dir):
    docs = g.documents(spark, sf_dir)
    made = t.document_id(F.col("source_path"), F.col("created_at"), F.col("title"))
    return docs.select("id", t.well_formed_id(made).alias("made"), t.well_formed_id(F.col("id")).alias("plain"))


def q14_1_dates(spark, sf_dir):
    docs = g.documents(spark, sf_dir)
    value = F.when(F.col("doc_type") == "note", F.col("title")).when(F.col("doc_type") == "memo", F.concat("created_at", F.lit("+02:00"))).otherwise(F.col("created_at"))
    return docs.select("id", F.date_format(t.parse_date(value), "yyyy-MM-dd HH:mm:ss").alias("at"))


def q14_15_even_picks(spark, sf_dir):
    lines = g.passages(spark, sf_dir).groupBy("document_id").agg(F.sort_array(F.collect_list("chunk_index")).alias("chunks"))
    return lines.select("document_id", F.array_join(t.even_picks(F.col("chunks"), 4), ",").alias("picks"))


def q17_6_confirm_staging(spark, sf_dir):
    """References become proposals; the inferred ones are confirmed."""
    edges = g.edges(spark, sf_dir).select("id", "source_id", "target_id", "edge_type", "rationale")
    staging = edges.where("edge_type = 'references'").select(F.concat(F.lit("p:"), "id").alias("id"), "source_id", "target_id", "edge_type", "rationale").withColumn("edge_type", F.when(F.col("source_id") < F.col("target_id"), "covers").otherwise("references"))
    after, left = inference.confirm_staging(staging, edges, staging.where("rationale like 'inferred:%'").select("id"))
    return after.groupBy("edge_type").agg(F.count("*").alias("n")).withColumn("table", F.lit("edges")).unionByName(left.groupBy("edge_type").agg(F.count("*").alias("n")).withColumn("table", F.lit("staging")))


def _two_rankings(spark, sf_dir):
    """Two rankings of the documents of each source: by date and by title."""
    docs = g.documents(spark, sf_dir).select("id", "title", "created_at", F.element_at("tags", 2).alias("query"))
    one = docs.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("created_at", "id")))
    two = docs.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("title", "id")))
    named = lambda df: df.select("query", F.col("id").alias("document_id"), "rank")
    return named(one), named(two)


def q18_2_rbo(spark, sf_dir):
    one, two = (evaluation.lists(r.where("rank <= 6")) for r in _two_rankings(spark, sf_dir))
    both = one.join(two.withColumnRenamed("documents", "other"), "query")
    return both.select("query", F.round(evaluation.rank_biased_overlap(F.col("documents"), F.col("other")), 9).alias("rbo"))


def q18_6_verdicts(spark, sf_dir):
    """Verdict by query from the overlap of both rankings, as fidelity and as a gap in relevance."""
    one, two = (evaluation.lists(r.where("rank <= 10")) for r in _two_rankings(spark, sf_dir))
    rows = one.join(two.withColumnRenamed("documents", "other"), "query").select("query", F.round(evaluation.overlap_at_k(F.col("documents"), F.col("other"), 10), 9).alias("overlap"))
    fidelity = F.when(F.col("overlap") >= 0.9, evaluation.recommend_fidelity(1, 0.9)).when(F.col("overlap") < 0.75, evaluation.recommend_fidelity(1, 0.7)).otherwise(evaluation.recommend_fidelity(0.8, 1))
    gap = 1 - F.col("overlap")
    relevance = F.when(gap <= 0.05, evaluation.recommend_relevance(0.05)).when(gap > 0.1, evaluation.recommend_relevance(0.2)).otherwise(evaluation.recommend_relevance(0.07))
    return rows.select("query", "overlap", fidelity.alias("fidelity"), relevance.alias("relevance"))


def q18_8_assertions(spark, sf_dir):
    """Must the first documents by title be among the first ten by date?"""
    one, two = _two_rankings(spark, sf_dir)
    return evaluation.retrieval_assertions(one, two.where("rank <= 3").select("query", "document_id"), 10)


QUERIES = {n: f for n, f in list(globals().items()) if n.startswith("q") and callable(f)}

_RANKS = """r AS (SELECT tags[2] AS query, id, row_number() OVER (PARTITION BY tags[2] ORDER BY created_at, id) AS r1, row_number() OVER (PARTITION BY tags[2] ORDER BY title, id) AS r2 FROM d)"""
_OVER = f"{_RANKS}, o AS (SELECT query, round(count(*) FILTER (r1 <= 10 AND r2 <= 10) / 10.0, 9) AS overlap FROM r GROUP BY query)"

ORACLE = {
    "q3_2_edge_counts": with_tables("SELECT source_id AS start_id, target_id AS document_id, edge_type, count(DISTINCT e.id) AS edges FROM e JOIN d ON d.id = source_id WHERE target_id IS NOT NULL GROUP BY ALL", D, E),
    "q8_18_head_first": with_tables(f"""{_SUP}, {_COMP}, {_SHAPE}, starts AS (SELECT chain AS walk, coalesce(root, least) AS id FROM shape WHERE roots = 0 UNION ALL SELECT chain, id FROM degree WHERE newer = 0), {_BREADTH}
      SELECT id, walk AS chain, place AS depth, place + 1 AS turn FROM o""", D, E),
    "q1_15_point_lookups": with_tables("SELECT e.id AS edge_id, d.id, title, lifecycle_status FROM e JOIN d ON d.id = e.source_id", D, E),
    "q3_3_hydration": with_tables("SELECT source_id AS start_id, target_id AS document_id, title, 1 AS depth, count(*) AS edge_count FROM e JOIN d ON d.id = target_id GROUP BY ALL", D, E),
    "q3_5_excerpts": with_tables("SELECT document_id, chunk_index, substr(content, 1, 80) AS content, length(content) > 80 AS cut FROM p", P),
    "q3_6_budget_fit": with_tables("""x AS (SELECT id, sum(strlen('{"id":"' || id || '","title":"' || title || '","doc_type":"' || doc_type || '"}') + 1) OVER (ORDER BY id) AS bytes FROM (SELECT * FROM d ORDER BY id LIMIT 1000))
      SELECT id, CAST(bytes AS BIGINT) AS bytes FROM x WHERE bytes <= 45000""", D),
    "q4_5_id_list": with_tables("SELECT id, title FROM d WHERE id IN ('d00000003', 'd00000019', 'nobody')", D),
    "q4_14_scopes": with_tables("""SELECT 'all' AS scope, count(*) AS documents FROM d UNION ALL SELECT 'authoritative', count(*) FILTER (authority_scope <> '') FROM d
      UNION ALL SELECT 'filtered', count(*) FILTER (doc_type = 'note' AND TRUE) FROM d""", D),
    "q4_16_threshold": with_tables("SELECT id, CASE WHEN pipeline_status <> 'failed' THEN n % 100 / 100.0 END AS score FROM d WHERE pipeline_status = 'failed' OR n % 100 >= 35", D),
    "q4_8_resolved": with_tables("""w AS (SELECT created_by AS key, created_by_name AS name, CAST(created_at AS TIMESTAMP) AS stamp FROM d UNION ALL SELECT last_modified_by, last_modified_by_name, CAST(updated_at AS TIMESTAMP) FROM d
        UNION ALL SELECT created_by, created_by_name, CAST(created_at AS TIMESTAMP) FROM e),
      l AS (SELECT key, name, row_number() OVER (PARTITION BY key ORDER BY stamp DESC, name DESC) AS k FROM w WHERE name IS NOT NULL) SELECT key FROM l WHERE k = 1 AND (lower(name) = 'user 3' OR key = 'user 3')""", D, E),
    "q8_17_resolution_trace": with_tables(f"""{_SUP}, {_FAM},
      gone AS (SELECT fam.id AS start_id, x.retracted_edge_id AS eid FROM e x JOIN fam ON fam.ancestor = coalesce(x.source_valid_from_version, x.source_id) WHERE x.edge_type = 'retracts'),
      v AS (
        SELECT e.source_id AS start_id, e.id, CASE resolution_policy WHEN 'none' THEN TRUE
            WHEN 'transitive_source' THEN EXISTS (SELECT 1 FROM fam f WHERE f.id = e.source_id AND f.ancestor = e.source_valid_from_version)
            WHEN 'transitive_both' THEN EXISTS (SELECT 1 FROM fam f WHERE f.id = e.source_id AND f.ancestor = e.source_valid_from_version) AND EXISTS (SELECT 1 FROM fam f WHERE f.id = e.target_id AND f.ancestor = e.target_valid_from_version)
            ELSE FALSE END AS hit,
          resolution_policy LIKE 'trans%' AND EXISTS (SELECT 1 FROM gone WHERE gone.start_id = e.source_id AND gone.eid = e.id) AS taken,
          valid_until_version IS NOT NULL AND valid_until_version <> e.source_id AND EXISTS (SELECT 1 FROM fam f WHERE f.id = e.source_id AND f.ancestor = valid_until_version) AS closed
        FROM e WHERE target_id IS NOT NULL)
      SELECT start_id, id, CASE WHEN hit THEN 'anchor_hit' ELSE 'anchor_miss' END AS event FROM v
      UNION ALL SELECT start_id, id, 'retracts_applied' FROM v WHERE hit AND taken UNION ALL SELECT start_id, id, 'tombstone_applied' FROM v WHERE hit AND NOT taken AND closed""", D, E),
    "q9_9_row_cap": with_tables("""s AS (SELECT source_id AS start_id, id, target_id AS to_id FROM e WHERE target_id IS NOT NULL UNION ALL SELECT target_id, id, source_id FROM e WHERE target_id IS NOT NULL),
      x AS (SELECT s.*, row_number() OVER (ORDER BY start_id, s.id, to_id) AS rank, count(*) OVER () > 10000 AS truncated FROM s JOIN d ON d.id = start_id) SELECT * FROM x WHERE rank <= 10000""", D, E),
    "q10_3_state_sets": with_tables("SELECT lifecycle_status, FALSE AS terminal, lifecycle_status IN ('active', 'completed', 'relocated') AS surviving, count(*) AS documents FROM d GROUP BY 1", D),
    "q10_1_apply_lifecycle": with_tables("""SELECT id, CASE WHEN doc_type = 'note' AND lifecycle_status IN ('active', 'completed') THEN 'archived' WHEN doc_type = 'memo' AND lifecycle_status = 'archived' THEN 'active'
      WHEN doc_type IN ('report', 'checklist') AND lifecycle_status = 'active' THEN 'completed' ELSE lifecycle_status END AS lifecycle_status FROM d""", D),
    "q13_8_embedding_input": with_tables("SELECT document_id, chunk_index, md5(heading_path || chr(10) || chr(10) || content) AS digest FROM p", P),
    "q13_11_versions": with_tables("""SELECT id, 'v' || n % 12 || CASE WHEN n % 3 <> 0 THEN '_' || n % 5 ELSE '' END || CASE WHEN n % 3 = 2 THEN '_7' ELSE '' END AS version, CAST(n % 12 AS INTEGER) AS major,
      CAST(CASE WHEN n % 3 <> 0 THEN n % 5 ELSE 0 END AS INTEGER) AS minor, CASE WHEN n % 3 = 2 THEN 7 ELSE 0 END AS patch,
      n % 12 || '.' || CASE WHEN n % 3 <> 0 THEN n % 5 ELSE 0 END || CASE WHEN n % 3 = 2 THEN '.7' ELSE '' END AS shown FROM d""", D),
    "q13_13_markup": "SELECT page_id, md5(translate(html, '<>', '  ')) AS digest FROM pages",
    "q13_18_structure_echo": "SELECT conv_id, turn, unnest([1, 2]) AS line, unnest(['heading', 'list']) AS kind FROM conversations WHERE text IS NOT NULL",
    "q13_22_token_budget": with_tables("SELECT id, CAST(least(floor(200 + 0.15 * len(list_filter(string_split(text, ' '), lambda w: w <> ''))), 1000) AS INTEGER) AS budget FROM d", D),
    "q13_23_cids": with_tables("SELECT id, CASE WHEN n % 140 BETWEEN 32 AND 126 THEN chr(CAST(n % 140 AS INTEGER)) ELSE '(cid:' || n % 140 || ')' END || 'x(cid:7)' || title AS text FROM d", D),
    "q13_12_well_formed": with_tables("SELECT id, TRUE AS made, FALSE AS plain FROM d", D),
    "q14_1_dates": with_tables("""SELECT id, CASE WHEN doc_type = 'note' THEN NULL WHEN doc_type = 'memo' THEN strftime(CAST(created_at AS TIMESTAMP) - INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S')
      ELSE strftime(CAST(created_at AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') END AS at FROM d""", D),
    "q14_15_even_picks": with_tables("""c AS (SELECT document_id, list(chunk_index ORDER BY chunk_index) AS l FROM p GROUP BY 1)
      SELECT document_id, CASE WHEN len(l) <= 4 THEN array_to_string(l, ',') ELSE array_to_string([l[1], l[1 + (len(l) - 1) // 3], l[1 + 2 * (len(l) - 1) // 3], l[len(l)]], ',') END AS picks FROM c""", P),
    "q17_6_confirm_staging": with_tables("""s AS (SELECT 'p:' || id AS id, source_id, target_id, CASE WHEN source_id < target_id THEN 'covers' ELSE 'references' END AS kind, rationale FROM e WHERE edge_type = 'references'),
      a AS (SELECT edge_type FROM e UNION ALL SELECT kind FROM s WHERE rationale LIKE 'inferred:%' AND kind = 'covers')
      SELECT edge_type, count(*) AS n, 'edges' AS "table" FROM a GROUP BY 1 UNION ALL SELECT kind, count(*), 'staging' FROM s WHERE rationale NOT LIKE 'inferred:%' GROUP BY 1""", D, E),
    "q18_2_rbo": with_tables(f"""{_RANKS}, k AS (SELECT unnest(range(1, 7)) AS j), n AS (SELECT query, least(count(*), 6) AS depth FROM r GROUP BY query),
      x AS (SELECT n.query, depth, j, (SELECT count(*) FROM r WHERE r.query = n.query AND r1 <= j AND r2 <= j) / j AS a FROM n, k WHERE j <= depth)
      SELECT query, round(max(CASE WHEN j = depth THEN a * pow(0.9, depth) END) + sum(a * pow(0.9, j)) * 0.1 / 0.9, 9) AS rbo FROM x GROUP BY query""", D),
    "q18_6_verdicts": with_tables(f"""{_OVER} SELECT query, overlap, CASE WHEN overlap >= 0.9 THEN 'native' WHEN overlap < 0.75 THEN 'escalate' ELSE 'judge' END AS fidelity,
      CASE WHEN 1 - overlap <= 0.05 THEN 'equivalent' WHEN 1 - overlap > 0.1 THEN 'worse' ELSE 'judge' END AS relevance FROM o""", D),
    "q18_8_assertions": with_tables(f"{_RANKS} SELECT query, id AS document_id, r1 <= 10 AS passed, CASE WHEN r1 <= 50 THEN r1 END AS rank FROM r WHERE r2 <= 3", D),
}
