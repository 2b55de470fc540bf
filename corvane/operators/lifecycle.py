"""Lifecycle transitions, metadata patches and table changes as batch transformations."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The base transition table: from state, action, to state, whether it makes an edge (fixed values).
TRANSITIONS = (
    ("(new)", "ingest", "active", False),
    ("active", "supersede", "archived", True),
    ("active", "archive", "archived", False),
    ("active", "complete", "completed", False),
    ("completed", "archive", "archived", False),
    ("archived", "reactivate", "active", False),
    ("active", "relocate", "relocated", False),
    ("completed", "relocate", "relocated", False),
)


def transitions(spark: SparkSession, rows: Iterable[tuple] = TRANSITIONS) -> DataFrame:
    """The table as a DataFrame; it must have exactly one row from ``(new)``."""
    rows = list(rows)
    if sum(r[0] == "(new)" for r in rows) != 1:
        raise ValueError("exactly one transition starts at (new)")
    return spark.createDataFrame(rows, "from_state string, action string, to_state string, creates_edge boolean")


def set_lifecycle(docs: DataFrame, requests: DataFrame, table: DataFrame) -> DataFrame:
    """Outcome of each request (id, action): the new state, or why not.

    Errors: not_found, unknown_action, invalid_transition (a document without a state has no transition).
    """
    table = F.broadcast(table)  # the configured transitions, a handful
    known = F.broadcast(table.select("action").distinct().withColumn("known", F.lit(True)))
    held = docs.select("id", "lifecycle_status", F.lit(True).alias("held"))
    rows = requests.join(held, "id", "left").join(known, "action", "left").join(table, (F.col("lifecycle_status") == table.from_state) & (requests.action == table.action), "left")
    error = F.when(F.col("held").isNull(), "not_found").when(F.col("known").isNull(), "unknown_action").when(F.col("to_state").isNull(), "invalid_transition")
    return rows.select("id", requests.action, "lifecycle_status", "to_state", F.coalesce("creates_edge", F.lit(False)).alias("creates_edge"), error.alias("error"))


def apply_lifecycle(docs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Documents after the outcomes without error."""
    done = outcomes.where("error is null").groupBy("id").agg(F.min("to_state").alias("to_state"))
    return docs.join(done, "id", "left").withColumn("lifecycle_status", F.coalesce("to_state", "lifecycle_status")).select(*docs.columns)


def terminal_states(rows: Iterable[tuple] = TRANSITIONS) -> set[str]:
    rows = list(rows)
    return {r[2] for r in rows} - {r[0] for r in rows}


def supersession_surviving(rows: Iterable[tuple] = TRANSITIONS) -> set[str]:
    """States that no supersession leads to."""
    rows = list(rows)
    return {s for r in rows for s in (r[0], r[2])} - {r[2] for r in rows if r[1] == "supersede"} - {"(new)"}


def patch_tags(docs: DataFrame, patches: DataFrame) -> DataFrame:
    """(id, tags, error) after patches (id, add, remove).

    Adding a tag that is there or removing one that is not is refused; kept tags
    stay in place and new ones follow in the caller's order.
    """
    add, remove = F.coalesce("add", F.array().cast("array<string>")), F.coalesce("remove", F.array().cast("array<string>"))
    error = (
        F.when(F.col("tags").isNull(), "not_found").when(F.size(F.array_except(remove, "tags")) > 0, "remove_absent")
        .when(F.size(F.array_intersect(add, F.array_except("tags", remove))) > 0, "add_present")
    )
    after = F.concat(F.filter("tags", lambda t: ~F.array_contains(remove, t)), add)
    return patches.join(docs.select("id", "tags"), "id", "left").select("id", F.when(error.isNull(), after).otherwise(F.col("tags")).alias("tags"), error.alias("error"))


def unique_collisions(docs: DataFrame, edges: DataFrame, doc_type: str, field: str) -> DataFrame:
    """Chain heads of one type that share a value of a metadata field with another: value, id, n (heads of that value)."""
    superseded = edges.where("edge_type = 'supersedes'").select(F.col("target_id").alias("id")).distinct()
    heads = docs.where(F.col("doc_type") == doc_type).join(superseded, "id", "left_anti")
    held = heads.select(F.get_json_object("tier3", f"$.{field}").alias("value"), "id").where("value is not null")
    shared = held.groupBy("value").agg(F.count("*").alias("n")).where("n > 1")
    return held.join(shared, "value").select("value", "id", "n")


def insert(table: DataFrame, rows: DataFrame, key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(table after, outcome): rows whose key is new are added; of repeated new ones the first by all columns.

    Null parts of a key never match, as in SQL.
    """
    whole = " and ".join(f"`{k}` is not null" for k in key)
    first = rows.where(whole).groupBy(*key).agg(F.min(F.struct(*rows.columns)).alias("m")).select("m.*").unionByName(rows.where(f"not ({whole})"))
    held = table.select(*key).distinct().withColumn("held", F.lit(True))
    outcome = first.join(held, list(key), "left").select(*rows.columns, F.col("held").isNull().alias("created"))
    return table.unionByName(outcome.where("created").drop("created"), allowMissingColumns=True), outcome


def upsert(table: DataFrame, rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows replace those of the same key."""
    return table.join(rows.select(*key), list(key), "left_anti").unionByName(rows, allowMissingColumns=True)


def remove_documents(ids: DataFrame, docs: DataFrame, edges: DataFrame, passages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables without some documents, their edges at both ends and their passages."""
    gone = ids.select("id").distinct()
    left = docs.join(gone, "id", "left_anti")
    links = edges.join(gone.withColumnRenamed("id", "source_id"), "source_id", "left_anti").join(gone.withColumnRenamed("id", "target_id"), "target_id", "left_anti").select(*edges.columns)
    return left, links, passages.join(gone.withColumnRenamed("id", "document_id"), "document_id", "left_anti").select(*passages.columns)


def tombstone(edges: DataFrame, family: DataFrame, version: str) -> DataFrame:
    """Close edges that touch a lineage (ancestor) and are open with a policy other than none."""
    ends = family.select(F.col("ancestor").alias("end")).distinct()
    touched = edges.select("id", F.explode(F.array("source_id", "target_id")).alias("end")).join(ends, "end").select("id").distinct().withColumn("touched", F.lit(True))
    close = F.col("touched") & F.col("valid_until_version").isNull() & (F.coalesce("resolution_policy", F.lit("none")) != "none")
    return edges.join(touched, "id", "left").withColumn("valid_until_version", F.when(close, version).otherwise(F.col("valid_until_version"))).select(*edges.columns)


def clear_errors(docs: DataFrame, statuses: Sequence[str]) -> DataFrame:
    return docs.withColumn("pipeline_error", F.when(F.col("pipeline_status").isin(*statuses), None).otherwise(F.col("pipeline_error")))


def validate_links(links: DataFrame, docs: DataFrame, edges: DataFrame, types: Sequence[str]) -> DataFrame:
    """Each wanted edge (source_id, target_id, edge_type) with its first error, in a fixed order of checks."""
    have = docs.select("id").distinct()
    s, t = have.select(F.col("id").alias("source_id"), F.lit(True).alias("s")), have.select(F.col("id").alias("target_id"), F.lit(True).alias("t"))
    old = edges.select("source_id", "target_id", "edge_type").distinct().withColumn("old", F.lit(True))
    rows = links.join(s, "source_id", "left").join(t, "target_id", "left").join(old, ["source_id", "target_id", "edge_type"], "left")
    error = (
        F.when(~F.col("edge_type").isin(*types), "unknown_type").when(F.col("source_id") == F.col("target_id"), "self_edge").when(F.col("s").isNull(), "source_not_found")
        .when(F.col("t").isNull() & (F.col("edge_type") != "retracts"), "target_not_found").when(F.col("old"), "already_exists")
    )
    return rows.select(*links.columns, error.alias("error"))
