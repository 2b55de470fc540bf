"""Edge plans, backfills, sweeps, recovery and intake reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .passages import split_lines


def executed_plan(plan: DataFrame, ids: DataFrame, docs: DataFrame, edges: DataFrame) -> DataFrame:
    """Outcome of every row of an edge plan: its columns, source_id, target_id and outcome.

    ``plan`` has repair_group, action (add or remove), source_path, target_path, edge_type,
    tier; ``ids`` resolves paths (path, id).  Adds come before removals: an add of tier 2 is
    staged; one of tier 1 is written, or ``landed`` if the edge is there, or refused: a
    supersession needs a predecessor that is active (``illegal_transition``), every edge two known
    files (``ingestion_failed``).  If any add of a group is refused, its removals are withheld.
    """
    one = lambda side: ids.select(F.col("path").alias(f"{side}_path"), F.col("id").alias(f"{side}_id"))
    rows = plan.join(one("source"), "source_path", "left").join(one("target"), "target_path", "left")
    state = docs.select(F.col("id").alias("target_id"), F.col("lifecycle_status").alias("state"))
    there = edges.select("source_id", "target_id", "edge_type").distinct().withColumn("there", F.lit(True))
    known = rows.join(state, "target_id", "left").join(there, ["source_id", "target_id", "edge_type"], "left")
    refused = (
        F.when(F.col("source_id").isNull() | F.col("target_id").isNull(), "ingestion_failed")
        .when((F.col("edge_type") == "supersedes") & F.col("there").isNull() & (F.col("tier") == 1) & (F.coalesce("state", F.lit("")) != "active"), "illegal_transition")
    )
    judged = known.withColumn("refused", F.when(F.col("action") == "add", refused))
    # One flag a group; a group is aggregated, never gathered.
    held = judged.where("refused is not null").select("repair_group").distinct().withColumn("held", F.lit(True))
    add = F.when(F.col("refused").isNotNull(), F.col("refused")).when(F.col("there"), "landed").when(F.col("tier") == 2, "staged").otherwise("created")
    remove = F.when(F.col("held"), "withheld").when(F.col("there"), "removed").otherwise("absent")
    return judged.join(held, "repair_group", "left").select(*plan.columns, "source_id", "target_id", F.when(F.col("action") == "add", add).otherwise(remove).alias("outcome"))


def surfaces_from_headers(passages: DataFrame, surfaces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(passages, surfaces) after header rows (chunk_index -1) became the surfaces of documents that had none; all header rows go."""
    heads = passages.where("chunk_index = -1").select("document_id", F.col("content").alias("matchable"))
    fresh = heads.groupBy("document_id").agg(F.min("matchable").alias("matchable")).join(surfaces, "document_id", "left_anti")
    return passages.where("chunk_index >= 0"), surfaces.unionByName(fresh)


def with_structure(passages: DataFrame, derived: Column) -> DataFrame:
    """Passages whose missing ``structure`` was derived."""
    return passages.withColumn("structure", F.coalesce("structure", derived))


def divided(passages: DataFrame, most: int) -> DataFrame:
    """Passages of at most ``most`` characters: longer ones are cut at lines; chunk_index and piece order them."""
    long = F.length("content") > most
    cut = split_lines(passages.where(long).select(F.struct("document_id", "chunk_index").alias("document_id"), F.col("content").alias("text")), most)
    pieces = cut.select("document_id.document_id", "document_id.chunk_index", "piece", F.col("text").alias("content"))
    return passages.where(~long).select("document_id", "chunk_index", F.lit(0).alias("piece"), "content").unionByName(pieces)


def empty_projections(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """(id) of the documents without an abstract that have no passage."""
    return docs.where("pipeline_status = 'abstraction_skipped'").select("id").join(passages.select(F.col("document_id").alias("id")).distinct(), "id", "left_anti")


def migration_report(changes: dict[str, DataFrame]) -> DataFrame:
    """(step, changed) of the backfills that changed something, by the rows each would change."""
    counted = [rows.agg(F.count("*").alias("changed")).withColumn("step", F.lit(name)) for name, rows in changes.items()]
    out = counted[0]
    for c in counted[1:]:
        out = out.unionByName(c)
    return out.where("changed > 0").select("step", "changed")


def recovery(docs: DataFrame, indexed: DataFrame) -> DataFrame:
    """(id, action) for documents that a stop left unfinished: abstract_only where the passages are those of the present source, else re_index.

    ``indexed`` has document_id and the source hash that its passages were made from.
    """
    open_ = docs.where(~F.col("pipeline_status").isin("abstraction_complete", "abstraction_skipped", "failed") | F.col("pipeline_status").isNull())
    made = indexed.select(F.col("document_id").alias("id"), F.col("hash").alias("made")).distinct()
    rows = open_.select("id", "source_content_hash").join(made, (F.col("made") == F.col("source_content_hash")) & (open_["id"] == made["id"]), "left")
    return rows.groupBy(open_["id"]).agg(F.max(F.col("made").isNotNull()).alias("current")).select("id", F.when(F.col("current"), "abstract_only").otherwise("re_index").alias("action"))


def sweep(docs: DataFrame, include_pdf: bool = False) -> DataFrame:
    """(id, outcome) of the deferred documents: reabstract, or skipped because of a kind, a state or no text."""
    waiting = docs.where("pipeline_status = 'abstraction_skipped'")
    outcome = F.when(F.lower("source_path").endswith(".pdf") & F.lit(not include_pdf), "skipped_kind").when(F.col("lifecycle_status") == "archived", "skipped_state").when(F.coalesce(F.trim("text"), F.lit("")) == "", "skipped_empty").otherwise("reabstract")
    return waiting.select("id", outcome.alias("outcome"))


def intake(files: DataFrame, docs: DataFrame, kind: Column) -> DataFrame:
    """Dry run of an intake: path, verdict (unsupported, duplicate_in_batch, duplicate, would_supersede or would_create) and the document it meets.

    ``files`` has path and hash.  Of files of one content the first by path counts.  A known
    path with new content would supersede its document.
    """
    first = F.row_number().over(Window.partitionBy("hash").orderBy("path"))
    same = docs.groupBy(F.col("source_content_hash").alias("hash")).agg(F.min("id").alias("twin"))
    at = docs.groupBy(F.col("source_path").alias("path")).agg(F.max("id").alias("before"))
    rows = files.withColumn("kind", kind).withColumn("turn", first).join(same, "hash", "left").join(at, "path", "left")
    verdict = F.when(F.col("kind").isNull(), "unsupported").when(F.col("twin").isNotNull(), "duplicate").when(F.col("turn") > 1, "duplicate_in_batch").when(F.col("before").isNotNull(), "would_supersede").otherwise("would_create")
    return rows.select("path", verdict.alias("verdict"), F.when(verdict == "duplicate", F.col("twin")).when(verdict == "would_supersede", F.col("before")).alias("document_id"))


def coverage(observed: Column, represented: Column, total: Column) -> Column:
    """(scope, ratio) of a document's processing: complete where all of a known total is represented, limited where some is, else unknown."""
    ratio = F.when(total > 0, represented / total)
    sound = (represented <= observed) & (observed <= total)
    return F.struct(F.when(total.isNull() | ~F.coalesce(sound, F.lit(False)), "unknown").when(represented == total, "complete").otherwise("limited").alias("scope"), F.round(ratio, 6).alias("ratio"))


def graded(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(judgements, errors) of a gold set (query, primary, related).

    The primary document has grade 2, related ones 1; where one is both, the higher grade
    holds.  An entry without a query or a primary is an error and judges nothing.
    """
    problem = F.when(F.coalesce(F.trim("query"), F.lit("")) == "", "no_query").when(F.coalesce(F.trim("primary"), F.lit("")) == "", "no_primary")
    rows = entries.withColumn("problem", problem)
    one = F.concat(F.array(F.struct(F.col("primary").alias("document_id"), F.lit(2).alias("grade"))), F.transform(F.coalesce("related", F.array().cast("array<string>")), lambda d: F.struct(d.alias("document_id"), F.lit(1).alias("grade"))))
    judged = rows.where("problem is null").select("query", F.explode(one).alias("j")).groupBy("query", "j.document_id").agg(F.max("j.grade").alias("grade"))
    return judged, rows.where("problem is not null").select("query", "primary", "problem")


def evidence(facts: DataFrame, budget: int) -> DataFrame:
    """The facts (document_id, region, field, turn, text) that fit a document's budget of bytes, dealt round robin over its groups.

    The first fact of every group comes first, then the second ones; a document's facts stop
    before the one that passes the budget.  ``slot`` is the place in the deal.
    """
    deal = Window.partitionBy("document_id").orderBy("turn", "region", "field", "text")
    rows = facts.withColumn("slot", F.row_number().over(deal)).withColumn("cost", F.sum(F.octet_length("text")).over(deal.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where(F.col("cost") <= budget).select("document_id", "region", "field", "text", "slot", "cost")
