"""Queries of the write path: inserts, supersession, patches, deletions, configuration checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import changes, lifecycle
from ..operators.passage_table import PassageTable
from ..plans.lineage import fresh_path
from ..plans.oracle_tables import D, E, P, with_tables
from ..sources import graph_tables as g


def _requests(spark, sf_dir):
    """A supersession for every reference: its target is to be superseded by its source."""
    return g.edges(spark, sf_dir).where("edge_type in ('references', 'depends_on')").select(F.col("target_id").alias("predecessor_id"), F.col("source_id").alias("successor_id"))


_REQUESTS = "q AS (SELECT DISTINCT target_id AS predecessor_id, source_id AS successor_id FROM e WHERE edge_type IN ('references', 'depends_on'))"
_JUDGED = """j AS (
  SELECT q.*, p.lifecycle_status AS from_state,
    CASE WHEN q.predecessor_id = q.successor_id THEN 'self_edge' WHEN p.id IS NULL THEN 'predecessor_not_found' WHEN s.id IS NULL THEN 'successor_not_found'
      WHEN EXISTS (SELECT 1 FROM e WHERE edge_type = 'supersedes' AND target_id = q.predecessor_id) THEN 'already_superseded'
      WHEN p.lifecycle_status <> 'active' THEN 'illegal_transition' END AS first_error
  FROM q LEFT JOIN d p ON p.id = q.predecessor_id LEFT JOIN d s ON s.id = q.successor_id),
k AS (
  SELECT *, CASE WHEN first_error IS NULL AND successor_id > min(successor_id) FILTER (first_error IS NULL) OVER (PARTITION BY predecessor_id) THEN 'taken' ELSE first_error END AS error
  FROM j)"""


def q2_1_insert_documents(spark, sf_dir):
    """Every document comes in twice under different titles; those that are not archived are there already."""
    docs = g.documents(spark, sf_dir).select("id", "title", "lifecycle_status")
    incoming = docs.select("id", "title").unionByName(docs.select("id", F.concat("title", F.lit("!")).alias("title")))
    after, outcome = lifecycle.insert(docs.where("lifecycle_status <> 'archived'").select("id", "title"), incoming, ["id"])
    return after.join(outcome.select("id", "created"), "id")


def q2_2_update_documents(spark, sf_dir):
    docs = g.documents(spark, sf_dir)
    drafts = docs.where("not metadata_confirmed").withColumn("doc_type", F.lit("draft"))
    return lifecycle.upsert(docs, drafts, ["id"]).select("id", "doc_type", "title")


def q2_6_delete_edges(spark, sf_dir):
    """Every edge that retracts one asks for that edge's deletion; some are not there."""
    edges = g.edges(spark, sf_dir)
    left, outcome = changes.delete_edges(edges, edges.where("retracted_edge_id is not null").select(F.col("retracted_edge_id").alias("id")))
    kept = left.select(F.col("id").alias("edge_id"), "edge_type", F.lit("kept").alias("state"))
    return kept.unionByName(outcome.select("edge_id", "edge_type", F.when(F.col("removed"), "removed").otherwise("not_found").alias("state")))


def q8_14_delete_preview(spark, sf_dir):
    edges = g.edges(spark, sf_dir)
    wanted = edges.where("valid_until_version is not null").select("id").unionByName(edges.select(F.concat(F.lit("no:"), "id").alias("id")))
    return changes.delete_edges(edges, wanted, dry_run=True)[1]


def q8_15_chain_ends(spark, sf_dir):
    return changes.chain_ends(g.documents(spark, sf_dir), g.edges(spark, sf_dir))


def q10_12_prepare_supersede(spark, sf_dir):
    return changes.prepare_supersede(g.documents(spark, sf_dir), g.edges(spark, sf_dir), _requests(spark, sf_dir))


def q2_7_supersede(spark, sf_dir):
    docs, edges = g.documents(spark, sf_dir).select("id", "lifecycle_status"), g.edges(spark, sf_dir)
    after, links = changes.supersede(docs, edges, _requests(spark, sf_dir))
    out = links.where("edge_type = 'supersedes'").groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("supersedes"))
    return after.join(out, "id", "left").select("id", "lifecycle_status", "is_chain_head", F.coalesce("supersedes", F.lit(0)).alias("supersedes"))


def q2_10_published(spark, sf_dir):
    """A bucketed table of all passages after a later attempt for English documents, a repeated one for others, and a stale one."""
    passages, docs = g.passages(spark, sf_dir), g.documents(spark, sf_dir).select(F.col("id").alias("document_id"), "doc_type")
    table = PassageTable.create(passages.select("document_id", "chunk_index", "content"), fresh_path(spark, "passages"))
    attempt = F.when(F.col("doc_type") == "report", 2).when(F.col("doc_type") == "note", 1).otherwise(0)
    requests = docs.select("document_id", attempt.alias("attempt"))
    incoming = passages.join(requests, "document_id").select("document_id", "attempt", "chunk_index", F.concat("content", F.lit(" #2")).alias("content"))
    table.publish(requests, incoming)
    return table.rows().select("document_id", "chunk_index", "attempt", "vectors_current", F.md5("content").alias("digest"))


def q2_10_replace_passages(spark, sf_dir):
    """Passages of English documents are replaced by ones with a mark at their end, without their last."""
    passages, docs = g.passages(spark, sf_dir), g.documents(spark, sf_dir).where("doc_type = 'report'").select(F.col("id").alias("document_id"))
    own = passages.join(docs, "document_id", "left_semi")
    last = own.groupBy("document_id").agg(F.max("chunk_index").alias("last"))
    incoming = own.join(last, "document_id").where("chunk_index < last or chunk_index = 0").withColumn("content", F.concat("content", F.lit(" #2")))
    return changes.replace_passages(passages, incoming).select("document_id", "chunk_index", F.md5("content").alias("digest"))


def q2_11_upsert_surfaces(spark, sf_dir):
    docs = g.documents(spark, sf_dir)
    surfaces = docs.where("pipeline_status <> 'failed'").select(F.col("id").alias("document_id"), "title", F.lit(None).cast("string").alias("tags"))
    fresh = docs.where("document_date is not null").select(F.col("id").alias("document_id"), "title", F.array_join("tags", " ").alias("tags"))
    return lifecycle.upsert(surfaces, fresh, ["document_id"])


def q2_13_filter_sync(spark, sf_dir):
    rows = changes.synced_filters(g.passages(spark, sf_dir), g.documents(spark, sf_dir))
    return rows.groupBy("doc_type", "lifecycle_status", "project").agg(F.count("*").alias("passages"), F.countDistinct("document_id").alias("documents"))


def q2_16_clear_errors(spark, sf_dir):
    docs = g.documents(spark, sf_dir).withColumn("pipeline_error", F.concat(F.lit("at "), "pipeline_status"))
    return lifecycle.clear_errors(docs, ["abstraction_complete", "abstraction_skipped"]).select("id", "pipeline_error")


def q2_17_marks(spark, sf_dir):
    return changes.marks(g.documents(spark, sf_dir), "authority_scope")


def q3_8_provenance(spark, sf_dir):
    return changes.stamped(g.edges(spark, sf_dir), "writer", "batch").groupBy("edge_type", "written_by", "client", "agent").agg(F.count("*").alias("edges"))


def q10_2_lifecycle_problems(spark, sf_dir):
    """The base rules of every project, and what is wrong with variants of them."""
    rules = lifecycle.transitions(spark).select("from_state", "action", "to_state", "creates_edge")
    config = F.explode(F.array(*map(F.lit, ("base", "two_starts", "no_start", "undeclared", "twice", "moves_on", "no_edge", "unsatisfied")))).alias("config")
    each = rules.select(config, "*").where("not (config = 'no_start' and from_state = '(new)')").withColumn("creates_edge", F.expr("creates_edge and config <> 'no_edge'"))
    more = spark.createDataFrame(
        [("two_starts", "(new)", "draft", "completed", False), ("undeclared", "active", "lose", "lost", False), ("twice", "active", "archive", "completed", False), ("moves_on", "relocated", "return", "active", False)],
        "config string, from_state string, action string, to_state string, creates_edge boolean",
    )
    states = spark.createDataFrame([("active", False, True), ("completed", False, True), ("archived", False, False), ("relocated", True, False)], "state string, relocated boolean, satisfies boolean").select(config, "*")
    return changes.lifecycle_problems(each.unionByName(more), states.withColumn("satisfies", F.expr("satisfies and config <> 'unsatisfied'")))


def q10_5_patch_metadata(spark, sf_dir):
    """A patch for every document, most of them legal: by its own tags, types and times."""
    docs = g.documents(spark, sf_dir)
    empty = F.array().cast("array<string>")
    patches = docs.select(
        F.when(F.col("project") == "proj4", F.concat(F.lit("no:"), "id")).otherwise(F.col("id")).alias("id"),
        F.when(F.col("authority_scope") == "", "2020-01-01T00:00:00").when(F.col("authority_scope") == "team", F.col("updated_at")).alias("expected_version"),
        F.when(F.col("doc_type") == "note", "moved").alias("project"), F.lit('{"b":"x\\"y","sev":2}').alias("put"),
        F.when(F.col("document_date").isNull(), F.array(F.lit("owner"))).otherwise(empty).alias("drop"),
        F.array(F.lit("new"), F.lit("pv3")).alias("add"), F.when(F.col("metadata_confirmed"), F.array(F.element_at("tags", 1))).otherwise(empty).alias("remove"),
    )
    found = changes.patch_metadata(docs, patches)
    return found.select("id", "error", "project", F.get_json_object("tier3", "$.b").alias("b"), F.get_json_object("tier3", "$.sev").alias("sev"), F.get_json_object("tier3", "$.owner").alias("owner"), F.array_join("tags", ",").alias("tags"))


def q10_6_version_tokens(spark, sf_dir):
    """Which of two callers' tokens are current: the document's time, and its time of creation."""
    docs = g.documents(spark, sf_dir)
    return docs.select("id", (F.col("updated_at") == F.col("created_at")).alias("unchanged"), F.concat("updated_at", F.lit("Z")).alias("token"))


def q10_15_malformed_edges(spark, sf_dir):
    """Edges with columns lost by their kind, split into those that can be read and a report."""
    edges = g.edges(spark, sf_dir).withColumns({
        "target_id": F.when(F.col("edge_type") != "sync_target", F.col("target_id")), "retracted_edge_id": F.when(F.col("created_by_name").isNotNull(), F.col("retracted_edge_id")),
        "created_at": F.when(F.col("rationale") == "manual", F.col("created_at")).otherwise(F.regexp_replace("created_at", "^2024-01-01T00", "2024-13-01T00")),
    })
    fine, report = changes.split_malformed(edges)
    return fine.select("id", F.lit(None).cast("string").alias("reason")).unionByName(report)


QUERIES = {n: f for n, f in list(globals().items()) if n.startswith("q") and callable(f)}

ORACLE = {
    "q2_1_insert_documents": with_tables("SELECT id, title, lifecycle_status = 'archived' AS created FROM d", D),
    "q2_2_update_documents": with_tables("SELECT id, CASE WHEN metadata_confirmed THEN doc_type ELSE 'draft' END AS doc_type, title FROM d", D),
    "q2_6_delete_edges": with_tables("""w AS (SELECT DISTINCT retracted_edge_id AS edge_id FROM e WHERE retracted_edge_id IS NOT NULL)
        SELECT id AS edge_id, edge_type, 'kept' AS state FROM e WHERE id NOT IN (SELECT edge_id FROM w)
        UNION ALL SELECT edge_id, edge_type, CASE WHEN e.id IS NULL THEN 'not_found' ELSE 'removed' END FROM w LEFT JOIN e ON e.id = edge_id""", D, E),
    "q8_14_delete_preview": with_tables("""w AS (SELECT id AS edge_id FROM e WHERE valid_until_version IS NOT NULL UNION SELECT 'no:' || id FROM e)
        SELECT edge_id, edge_type, e.id IS NOT NULL AS removed FROM w LEFT JOIN e ON e.id = edge_id""", D, E),
    "q8_15_chain_ends": with_tables("""SELECT id, id IN (SELECT target_id FROM e WHERE edge_type = 'supersedes') AS has_successor,
        id IN (SELECT source_id FROM e WHERE edge_type = 'supersedes') AS has_predecessor FROM d""", D, E),
    "q10_12_prepare_supersede": with_tables(f"{_REQUESTS}, {_JUDGED} SELECT predecessor_id, successor_id, from_state, CASE WHEN error IS NULL THEN 'archived' END AS to_state, error FROM k", D, E),
    "q2_7_supersede": with_tables(f"""{_REQUESTS}, {_JUDGED}, l AS (SELECT * FROM k WHERE error IS NULL),
        m AS (SELECT source_id AS id FROM e WHERE edge_type = 'supersedes' UNION ALL SELECT successor_id FROM l)
        SELECT d.id, coalesce(CASE WHEN l.predecessor_id IS NOT NULL THEN 'archived' END, lifecycle_status) AS lifecycle_status,
          l.predecessor_id IS NULL AND d.id NOT IN (SELECT target_id FROM e WHERE edge_type = 'supersedes') AS is_chain_head, (SELECT count(*) FROM m WHERE m.id = d.id) AS supersedes
        FROM d LEFT JOIN l ON l.predecessor_id = d.id""", D, E),
    "q2_10_published": with_tables("""r AS (SELECT p.*, doc_type = 'report' AS new FROM p JOIN d ON d.id = document_id)
        SELECT document_id, chunk_index, CASE WHEN new THEN 2 ELSE 1 END AS attempt, NULL AS vectors_current, md5(CASE WHEN new THEN content || ' #2' ELSE content END) AS digest FROM r
        UNION ALL SELECT id, NULL, CASE WHEN doc_type = 'report' THEN 2 WHEN doc_type = 'note' OR held THEN 1 ELSE 0 END, doc_type <> 'report' AND held, NULL FROM (SELECT *, id IN (SELECT document_id FROM p) AS held FROM d)""", D, P),
    "q2_10_replace_passages": with_tables("""r AS (SELECT p.*, doc_type, max(chunk_index) OVER (PARTITION BY document_id) AS last FROM p JOIN d ON d.id = document_id)
        SELECT document_id, chunk_index, md5(CASE WHEN doc_type = 'report' THEN content || ' #2' ELSE content END) AS digest FROM r WHERE doc_type <> 'report' OR chunk_index < last OR chunk_index = 0""", D, P),
    "q2_11_upsert_surfaces": with_tables("""SELECT id AS document_id, title, CASE WHEN document_date IS NOT NULL THEN array_to_string(tags, ' ') END AS tags FROM d
        WHERE document_date IS NOT NULL OR pipeline_status <> 'failed'""", D),
    "q2_13_filter_sync": with_tables("""SELECT doc_type, lifecycle_status, project, count(*) AS passages, count(DISTINCT document_id) AS documents FROM p JOIN d ON d.id = document_id GROUP BY ALL""", D, P),
    "q2_16_clear_errors": with_tables("SELECT id, CASE WHEN pipeline_status = 'failed' THEN 'at failed' END AS pipeline_error FROM d", D),
    "q2_17_marks": with_tables("SELECT id, authority_scope AS mark FROM d WHERE authority_scope IS NOT NULL", D),
    "q3_8_provenance": with_tables("SELECT edge_type, 'writer' AS written_by, 'batch' AS client, NULL AS agent, count(*) AS edges FROM e GROUP BY edge_type", D, E),
    "q10_2_lifecycle_problems": """SELECT * FROM (VALUES ('two_starts', 'not_one_start'), ('no_start', 'not_one_start'), ('undeclared', 'undeclared_state'), ('twice', 'ambiguous_rule'),
        ('moves_on', 'leaves_relocated'), ('no_edge', 'supersede_without_edge'), ('unsatisfied', 'nothing_satisfies')) t(config, problem)""",
    "q10_5_patch_metadata": with_tables("""w AS (
          SELECT CASE WHEN project = 'proj4' THEN 'no:' || id ELSE id END AS pid, CASE WHEN authority_scope = '' THEN '2020-01-01T00:00:00' WHEN authority_scope = 'team' THEN updated_at END AS version,
            CASE WHEN doc_type = 'note' THEN 'moved' END AS moved, document_date IS NULL AS drops, CASE WHEN metadata_confirmed THEN [tags[1]] ELSE [] END AS gone FROM d),
        x AS (
          SELECT w.*, d.*, json_exists(tier3, '$.owner') AS owned, list_filter(tags, lambda t: NOT list_contains(gone, t)) AS stay,
            CASE WHEN d.id IS NULL THEN 'not_found' WHEN version <> updated_at THEN 'version_conflict' WHEN drops AND NOT json_exists(tier3, '$.owner') THEN 'drop_absent'
              WHEN list_contains(list_filter(tags, lambda t: NOT list_contains(gone, t)), 'pv3') THEN 'add_present' END AS error
          FROM w LEFT JOIN d ON d.id = pid)
        SELECT pid AS id, error, CASE WHEN error IS NULL THEN coalesce(moved, project) ELSE project END AS project, CASE WHEN error IS NULL THEN 'x"y' END AS b, CASE WHEN error IS NULL THEN '2' END AS sev,
          CASE WHEN error IS NULL AND NOT drops THEN tier3 ->> '$.owner' END AS owner, array_to_string(CASE WHEN error IS NULL THEN list_concat(stay, ['new', 'pv3']) ELSE tags END, ',') AS tags
        FROM x""", D),
    "q10_6_version_tokens": with_tables("SELECT id, updated_at = created_at AS unchanged, updated_at || 'Z' AS token FROM d", D),
    "q10_15_malformed_edges": with_tables("""SELECT id, CASE WHEN edge_type IN ('sync_target') OR target_id IS NULL AND edge_type <> 'retracts' THEN 'no_target'
          WHEN edge_type = 'retracts' AND (retracted_edge_id IS NULL OR created_by_name IS NULL) THEN 'retracts_nothing'
          WHEN rationale <> 'manual' AND created_at LIKE '2024-01-01T00%' THEN 'bad_time' END AS reason FROM e""", D, E),
}
