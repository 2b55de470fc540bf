"""Edge and chain queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chain_order, graph
from ..plans.oracle_tables import D, E, with_tables
from ..sources import graph_tables as g


TERMINAL = ("abstraction_complete", "abstraction_skipped")


def _both(spark, sf_dir):
    return g.documents(spark, sf_dir).drop("text", "semantic_abstract"), g.edges(spark, sf_dir)


def q8_1_traverse(spark, sf_dir):
    docs, edges = _both(spark, sf_dir)
    return graph.traverse(edges, docs.select("id"), "outbound", depth=3)


def q8_1_traverse_both(spark, sf_dir):
    docs, edges = _both(spark, sf_dir)
    return graph.traverse(edges, docs.select("id"), "both", "supersedes", depth=3)


def q8_2_lineage(spark, sf_dir):
    return graph.lineage(*_both(spark, sf_dir))


def q8_3_chains(spark, sf_dir):
    return graph.chains(*_both(spark, sf_dir))


def q8_4_chain_heads(spark, sf_dir):
    return graph.chain_heads(*_both(spark, sf_dir))


def q8_5_chain_positions(spark, sf_dir):
    return chain_order.chain_order(*_both(spark, sf_dir))


def q8_5_chain_answers(spark, sf_dir):
    """Every document asks for its chain and the first three of it."""
    docs, edges = _both(spark, sf_dir)
    found = chain_order.chain_answers(docs, edges, docs, limit=3)
    return found.withColumn("available_edge_types", F.array_join("available_edge_types", ",")).withColumn("page", F.array_join("page", ","))


def q8_18_purge_order(spark, sf_dir):
    """All chains from their heads, branched ones as well; derivation edges stand as pending ones."""
    docs, edges = _both(spark, sf_dir)
    heads = docs.join(edges.where("edge_type = 'supersedes'").select(F.col("target_id").alias("id")), "id", "left_anti").select(F.col("id").alias("head_id"))
    return chain_order.purge_order(docs, edges, heads, edges.where("edge_type = 'derived_from'"), TERMINAL, allow_branched=True)


def q17_11_purge_chain(spark, sf_dir):
    """Every document is named as a head; what is none, or heads a branched chain, is refused."""
    docs, edges = _both(spark, sf_dir)
    return chain_order.purge_order(docs, edges, docs.select(F.col("id").alias("head_id")), edges.where("edge_type = 'sync_target'"), TERMINAL)


def q8_6_resolved_traverse(spark, sf_dir):
    docs, edges = _both(spark, sf_dir)
    return graph.resolved_traverse(docs, edges, docs.select("id"), depth=1).select("start_id", "id", "edge_type", "depth")


def q8_6_seeded_traverse(spark, sf_dir):
    """References from every document and what it supersedes, three rows a document at most."""
    docs, edges = _both(spark, sf_dir)
    return graph.seeded_traverse(docs, edges, docs.select("id"), "both", "references", row_cap=3)


def q8_7_nodes(spark, sf_dir):
    docs, edges = _both(spark, sf_dir)
    return graph.nodes(graph.traverse(edges, docs.select("id"), "outbound", depth=3))


def q8_12_preconditions(spark, sf_dir):
    return graph.preconditions(*_both(spark, sf_dir), ("active", "completed"))


def q8_16_edges(spark, sf_dir):
    return graph.edge_page(g.edges(spark, sf_dir), {"edge_type": "references"}, limit=100).select("id", "source_id", "target_id", "retracted_by", "retracted_at", "rank")


def q12_6_edge_counts(spark, sf_dir):
    return g.edges(spark, sf_dir).groupBy("edge_type").agg(F.count("*").alias("edges"))


def q17_7_drift(spark, sf_dir):
    return graph.drift(*_both(spark, sf_dir))


def q17_7_drift_summary(spark, sf_dir):
    return graph.drift_summary(graph.drift(*_both(spark, sf_dir)))


QUERIES = {k: v for k, v in list(globals().items()) if k.startswith("q") and callable(v)}

_WALK = """w AS (
    SELECT s.id AS start_id, st.id, st.from_id, st.to_id, st.edge_type, 1 AS depth, st.to_id = s.id AS closes, [s.id, st.to_id] AS path FROM seeds s JOIN steps st ON st.from_id = s.id
    UNION ALL SELECT w.start_id, st.id, st.from_id, st.to_id, st.edge_type, depth + 1, list_contains(w.path, st.to_id), list_append(w.path, st.to_id) FROM w JOIN steps st ON st.from_id = w.to_id WHERE NOT w.closes AND depth < 3)"""
_SEEDS = "seeds AS (SELECT id FROM d)"
_OUT = "steps AS (SELECT id, source_id AS from_id, target_id AS to_id, edge_type FROM e WHERE target_id IS NOT NULL)"
_SUP = "sup AS (SELECT source_id, target_id FROM e WHERE edge_type = 'supersedes')"
_FAM = "fam AS (SELECT id, id AS ancestor FROM d UNION SELECT fam.id, sup.target_id FROM fam JOIN sup ON sup.source_id = fam.ancestor)"
_COMP = "reach AS (SELECT id, id AS other FROM d UNION SELECT reach.id, x.b FROM reach JOIN (SELECT source_id AS a, target_id AS b FROM sup UNION ALL SELECT target_id, source_id FROM sup) x ON x.a = reach.other), comp AS (SELECT id, min(other) AS chain FROM reach GROUP BY 1)"
_HEADS = """hd AS (SELECT chain, count(*) AS heads, min(d.id) AS hid, min_by(source_content_hash, d.id) AS hh FROM comp JOIN d USING (id) WHERE id NOT IN (SELECT target_id FROM sup) GROUP BY 1),
  heads AS (SELECT c.chain, coalesce(heads, 0) AS heads, CASE WHEN heads = 1 THEN hid END AS head_id, CASE WHEN heads = 1 THEN hh END AS head_hash FROM (SELECT DISTINCT chain FROM comp) c LEFT JOIN hd USING (chain))"""
_DRIFT = """v AS (SELECT e.id, e.source_id, e.target_id, CASE WHEN heads <> 1 THEN 'nonlinear' WHEN d.source_content_hash IS NULL THEN 'recorded_null' WHEN d.source_content_hash <> head_hash THEN 'content_drift'
    WHEN head_id <> e.target_id THEN 'chain_advanced_no_content_change' ELSE 'current' END AS verdict
  FROM e JOIN comp ON comp.id = e.target_id JOIN heads USING (chain) JOIN d ON d.id = e.target_id WHERE e.edge_type IN ('sync_target', 'derived_from') AND valid_until_version IS NULL)"""

_SHAPE = """pairs AS (SELECT DISTINCT source_id AS s, target_id AS t FROM sup WHERE source_id <> target_id),
  degree AS (SELECT id, chain, (SELECT count(*) FROM pairs WHERE t = id) AS newer, (SELECT count(*) FROM pairs WHERE s = id) AS older FROM comp),
  shape AS (SELECT chain, count(*) FILTER (newer = 0) AS roots, max(newer) <= 1 AND max(older) <= 1 AS is_linear, min(id) FILTER (newer = 0) AS root, min(id) AS least FROM degree GROUP BY 1)"""
#: Breadth first: by the shortest paths, those by their ids.
_BREADTH = """path AS (SELECT walk, id, [id] AS way FROM starts UNION ALL SELECT walk, t, list_append(way, t) FROM path JOIN pairs ON s = id WHERE NOT list_contains(way, t)),
  o AS (SELECT walk, id, row_number() OVER (PARTITION BY walk ORDER BY len(way), way) - 1 AS place, count(*) OVER (PARTITION BY walk) AS length FROM (SELECT walk, id, min([CAST(len(way) AS VARCHAR)] || way) AS w, w[2:] AS way FROM path GROUP BY 1, 2))"""
#: Depth first in chains without cycles below their head: by the smallest path.
_PURGE = """way AS (SELECT id AS head_id, chain, id, [id] AS way FROM degree WHERE newer = 0 UNION ALL SELECT head_id, chain, t, list_append(way, t) FROM way JOIN pairs ON s = id WHERE NOT list_contains(way, t)),
  best AS (SELECT head_id, chain, id, min(way) AS way FROM way GROUP BY 1, 2, 3),
  every AS (SELECT h.id AS head_id, h.chain, c.id, way FROM degree h JOIN comp c ON c.chain = h.chain LEFT JOIN best b ON b.head_id = h.id AND b.id = c.id WHERE h.newer = 0),
  staged AS (SELECT source_id AS id FROM e WHERE edge_type = '{}' UNION SELECT target_id FROM e WHERE edge_type = '{}'),
  judged AS (SELECT head_id, every.chain, every.id, row_number() OVER (PARTITION BY head_id ORDER BY way IS NULL, way, every.id) - 1 AS turn, CASE WHEN every.id IN (SELECT id FROM staged) THEN 'pending_staging_edge' WHEN pipeline_status NOT LIKE 'abstraction%' THEN 'non_terminal_status' END AS cause FROM every JOIN d ON d.id = every.id)"""

ORACLE = {
    "q8_1_traverse": with_tables(f"{_SEEDS}, {_OUT}, {_WALK} SELECT start_id, id, from_id, to_id, edge_type, depth, closes FROM w", D, E),
    "q8_1_traverse_both": with_tables(f"{_SEEDS}, {_SUP}, steps AS (SELECT id, source_id AS from_id, target_id AS to_id, edge_type FROM e WHERE edge_type = 'supersedes' UNION ALL SELECT id, target_id, source_id, edge_type FROM e WHERE edge_type = 'supersedes'), {_WALK} SELECT start_id, id, from_id, to_id, edge_type, depth, closes FROM w", D, E),
    "q8_2_lineage": with_tables(f"{_SUP}, {_FAM} SELECT id, ancestor FROM fam", D, E),
    "q8_3_chains": with_tables(f"{_SUP}, {_COMP} SELECT id, chain FROM comp", D, E),
    "q8_4_chain_heads": with_tables(f"{_SUP}, {_COMP}, {_HEADS} SELECT chain, heads, head_id, head_hash FROM heads", D, E),
    "q8_5_chain_positions": with_tables(f"""{_SUP}, {_COMP}, {_SHAPE}, starts AS (SELECT chain AS walk, coalesce(root, least) AS id FROM shape WHERE roots = 0 UNION ALL SELECT chain, id FROM degree WHERE newer = 0), {_BREADTH}
      SELECT walk AS chain, o.id, length - 1 - place AS position, length, is_linear FROM o JOIN shape ON chain = walk""", D, E),
    "q8_5_chain_answers": with_tables(f"""{_SUP}, {_COMP}, {_SHAPE}, starts AS (SELECT id AS walk, id FROM comp JOIN shape USING (chain) WHERE roots = 0 UNION ALL SELECT chain, id FROM degree WHERE newer = 0), {_BREADTH},
      who AS (SELECT comp.id AS asked, CASE WHEN roots = 0 THEN comp.id ELSE chain END AS walk, is_linear FROM comp JOIN shape USING (chain)),
      kinds AS (SELECT id, string_agg(DISTINCT edge_type, ',' ORDER BY edge_type) AS types FROM (SELECT source_id AS id, edge_type FROM e UNION ALL SELECT target_id, edge_type FROM e) GROUP BY 1)
      SELECT asked AS id, coalesce(max(length - 1 - place) FILTER (o.id = asked), 0) AS query_position, arg_min(o.id, place) AS head_id, arg_max(o.id, place) AS tail_id, max(length) AS total_length, any_value(is_linear) AS is_linear,
        CASE WHEN max(length) = 1 THEN coalesce(any_value(types), '') END AS available_edge_types, coalesce(string_agg(o.id, ',' ORDER BY place DESC) FILTER (length - 1 - place < 3), '') AS page
      FROM who JOIN o USING (walk) LEFT JOIN kinds ON kinds.id = asked GROUP BY asked""", D, E),
    "q8_18_purge_order": with_tables(f"""{_SUP}, {_COMP}, {_SHAPE}, {_PURGE.replace("{}", "derived_from")}
      SELECT head_id, id, turn, cause, CASE WHEN max(cause) OVER (PARTITION BY head_id) IS NOT NULL THEN 'members' END AS refusal FROM judged""", D, E),
    "q17_11_purge_chain": with_tables(f"""{_SUP}, {_COMP}, {_SHAPE}, {_PURGE.replace("{}", "sync_target")}
      SELECT head_id, j.id, turn, cause, CASE WHEN max(cause) OVER (PARTITION BY head_id) IS NOT NULL THEN 'members' END AS refusal FROM judged j JOIN shape USING (chain) WHERE is_linear
      UNION ALL SELECT id, NULL, NULL, NULL, CASE WHEN newer > 0 THEN 'not_head' ELSE 'branched' END FROM degree JOIN shape USING (chain) WHERE newer > 0 OR NOT is_linear""", D, E),
    "q8_6_resolved_traverse": with_tables(f"""{_SUP}, {_FAM},
      gone AS (SELECT fam.id AS start_id, x.retracted_edge_id AS eid FROM e x JOIN fam ON fam.ancestor = coalesce(x.source_valid_from_version, x.source_id) WHERE x.edge_type = 'retracts')
      SELECT e.source_id AS start_id, e.id, e.edge_type, 1 AS depth FROM e WHERE target_id IS NOT NULL AND CASE resolution_policy WHEN 'none' THEN TRUE
          WHEN 'transitive_source' THEN EXISTS (SELECT 1 FROM fam f WHERE f.id = e.source_id AND f.ancestor = e.source_valid_from_version)
          WHEN 'transitive_both' THEN EXISTS (SELECT 1 FROM fam f WHERE f.id = e.source_id AND f.ancestor = e.source_valid_from_version) AND EXISTS (SELECT 1 FROM fam f WHERE f.id = e.target_id AND f.ancestor = e.target_valid_from_version)
          ELSE FALSE END
        AND NOT (resolution_policy LIKE 'trans%' AND EXISTS (SELECT 1 FROM gone WHERE gone.start_id = e.source_id AND gone.eid = e.id))
        AND NOT (valid_until_version IS NOT NULL AND valid_until_version <> e.source_id AND EXISTS (SELECT 1 FROM fam f WHERE f.id = e.source_id AND f.ancestor = valid_until_version))""", D, E),
    "q8_6_seeded_traverse": with_tables(f"""{_SUP}, {_FAM}, st AS (
        SELECT fam.id AS start_id, ancestor AS seed, e.id, 0 AS phase FROM fam JOIN e ON source_id = ancestor WHERE edge_type = 'references' AND target_id IS NOT NULL
        UNION ALL SELECT fam.id, ancestor, e.id, 1 FROM fam JOIN e ON target_id = ancestor WHERE edge_type = 'references'),
      n AS (SELECT *, row_number() OVER (PARTITION BY start_id ORDER BY phase, seed, id) AS k, count(*) OVER (PARTITION BY start_id) > 3 AS truncated FROM st)
      SELECT start_id, id, 1 AS depth, any_value(truncated) AS truncated FROM n WHERE k <= 3 GROUP BY 1, 2""", D, E),
    "q8_7_nodes": with_tables(f"{_SEEDS}, {_OUT}, {_WALK}, f AS (SELECT start_id, id, min(depth) AS depth, any_value(to_id) AS to_id FROM w GROUP BY 1, 2) SELECT start_id, to_id AS document_id, min(depth) AS depth, count(*) AS edge_count FROM f GROUP BY 1, 2", D, E),
    "q8_12_preconditions": with_tables(f"""{_SUP}, {_COMP}, {_HEADS}, j AS (SELECT e.source_id AS document_id, e.target_id, CASE WHEN comp.chain IS NULL THEN 'not found' WHEN heads = 0 THEN 'cyclic' WHEN heads > 1 THEN 'forked'
          WHEN h.pipeline_status = 'failed' THEN 'failed' WHEN h.lifecycle_status IN ('active', 'completed') THEN 'satisfied' ELSE 'unsatisfied' END AS verdict
        FROM e LEFT JOIN comp ON comp.id = e.target_id LEFT JOIN heads USING (chain) LEFT JOIN d h ON h.id = head_id WHERE e.edge_type = 'depends_on')
      SELECT document_id, target_id, verdict, verdict = 'satisfied' AS satisfied FROM j""", D, E),
    "q8_16_edges": with_tables("""r AS (SELECT * FROM (SELECT retracted_edge_id, id AS retracted_by, created_at AS retracted_at, row_number() OVER (PARTITION BY retracted_edge_id ORDER BY created_at, id) AS k FROM e WHERE edge_type = 'retracts') WHERE k = 1)
      SELECT * FROM (SELECT e.id, source_id, target_id, retracted_by, retracted_at, CAST(row_number() OVER (ORDER BY created_at DESC, e.id) AS INTEGER) AS rank FROM e LEFT JOIN r ON r.retracted_edge_id = e.id WHERE edge_type = 'references') WHERE rank <= 100""", D, E),
    "q12_6_edge_counts": with_tables("SELECT edge_type, count(*) AS edges FROM e GROUP BY 1", E),
    "q17_7_drift": with_tables(f"{_SUP}, {_COMP}, {_HEADS}, {_DRIFT} SELECT * FROM v", D, E),
    "q17_7_drift_summary": with_tables(f"{_SUP}, {_COMP}, {_HEADS}, {_DRIFT} SELECT n.verdict, count(v.id) AS edges FROM (SELECT unnest(['nonlinear', 'recorded_null', 'content_drift', 'chain_advanced_no_content_change']) AS verdict) n LEFT JOIN v USING (verdict) GROUP BY 1", D, E),
}
