"""The write path as batch transformations: each takes the tables before and gives those after, with an outcome per request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lifecycle import TRANSITIONS


def stamped(rows: DataFrame, actor: str, client: str, agent: str | None = None) -> DataFrame:
    """Rows with who wrote them, through which client and on whose behalf."""
    return rows.withColumns({"written_by": F.lit(actor), "client": F.lit(client), "agent": F.lit(agent).cast("string")})


def delete_edges(edges: DataFrame, ids: DataFrame, dry_run: bool = False) -> tuple[DataFrame, DataFrame]:
    """(edges after, outcome of each distinct id: edge_id, edge_type, removed); a dry run only tells what would go.

    ``removed`` is false for ids that no edge has.  Several edges of one id all go.
    """
    wanted = ids.select(F.col("id").alias("edge_id")).distinct()
    held = edges.groupBy(F.col("id").alias("edge_id")).agg(F.min("edge_type").alias("edge_type"))
    outcome = wanted.join(held, "edge_id", "left").select("edge_id", "edge_type", F.col("edge_type").isNotNull().alias("removed"))
    return (edges if dry_run else edges.join(wanted, edges["id"] == wanted["edge_id"], "left_anti")), outcome


def chain_ends(docs: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, has_successor, has_predecessor): whether a supersession edge points at a document, and whether one starts there."""
    moves = edges.where("edge_type = 'supersedes'")
    newer = moves.select(F.col("target_id").alias("id")).distinct().withColumn("newer", F.lit(True))
    older = moves.select(F.col("source_id").alias("id")).distinct().withColumn("older", F.lit(True))
    rows = docs.select("id").join(newer, "id", "left").join(older, "id", "left")
    return rows.select("id", F.col("newer").isNotNull().alias("has_successor"), F.col("older").isNotNull().alias("has_predecessor"))


def prepare_supersede(docs: DataFrame, edges: DataFrame, requests: DataFrame, rules: tuple = TRANSITIONS) -> DataFrame:
    """Each distinct request (predecessor_id, successor_id) with the predecessor's state after it, or the first error.

    Errors in this order: self_edge, predecessor_not_found, successor_not_found,
    already_superseded (an edge to it is there), illegal_transition (no rule
    ``supersede`` from its state), taken (another request of this batch with a smaller
    successor supersedes the same document).
    """
    states = [r[0] for r in rules if r[1] == "supersede"]
    to = next((r[2] for r in rules if r[1] == "supersede"), None)
    found = docs.select("id", "lifecycle_status")
    old = found.select(F.col("id").alias("predecessor_id"), F.col("lifecycle_status").alias("from_state"), F.lit(True).alias("p"))
    new = found.select(F.col("id").alias("successor_id"), F.lit(True).alias("s"))
    gone = edges.where("edge_type = 'supersedes'").select(F.col("target_id").alias("predecessor_id")).distinct().withColumn("gone", F.lit(True))
    rows = requests.select("predecessor_id", "successor_id").distinct().join(old, "predecessor_id", "left").join(new, "successor_id", "left").join(gone, "predecessor_id", "left")
    error = (
        F.when(F.col("predecessor_id") == F.col("successor_id"), "self_edge").when(F.col("p").isNull(), "predecessor_not_found").when(F.col("s").isNull(), "successor_not_found")
        .when(F.col("gone").isNotNull(), "already_superseded").when(~F.coalesce(F.col("from_state").isin(*states), F.lit(False)), "illegal_transition")
    )
    judged = rows.withColumn("error", error)
    # Of the legal requests for one document the one with the smallest successor goes first.
    first = judged.where("error is null").groupBy("predecessor_id").agg(F.min("successor_id").alias("first"))
    late = F.col("error").isNull() & (F.col("successor_id") > F.col("first"))
    named = judged.join(first, "predecessor_id", "left").withColumn("error", F.when(late, "taken").otherwise(F.col("error")))
    return named.select("predecessor_id", "successor_id", "from_state", F.when(F.col("error").isNull(), to).alias("to_state"), "error")


def supersede(docs: DataFrame, edges: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, edges) after the legal requests: predecessors change state and are no heads, edges lead from newer to older."""
    legal = prepare_supersede(docs, edges, requests).where("error is null")
    change = legal.select(F.col("predecessor_id").alias("id"), "to_state")
    heads = chain_ends(docs, edges).select("id", (~F.col("has_successor")).alias("was_head"))
    after = docs.join(change, "id", "left").join(heads, "id", "left")
    left = after.withColumn("lifecycle_status", F.coalesce("to_state", "lifecycle_status")).withColumn("is_chain_head", F.col("to_state").isNull() & F.col("was_head"))
    links = legal.select(
        F.concat(F.lit("s:"), "successor_id", F.lit(">"), "predecessor_id").alias("id"), F.col("successor_id").alias("source_id"), F.col("predecessor_id").alias("target_id"),
        F.lit("supersedes").alias("edge_type"), F.lit("none").alias("resolution_policy"),
    )
    return left.select(*docs.columns, "is_chain_head"), edges.unionByName(links, allowMissingColumns=True)


def replace_passages(passages: DataFrame, incoming: DataFrame) -> DataFrame:
    """Passages after those of the incoming documents were replaced as a whole."""
    return passages.join(incoming.select("document_id").distinct(), "document_id", "left_anti").select(*passages.columns).unionByName(incoming.select(*passages.columns))


def synced_filters(passages: DataFrame, docs: DataFrame) -> DataFrame:
    """Passages with their document's type, state and project, as filters on them need; passages without a document go."""
    return passages.join(docs.select(F.col("id").alias("document_id"), "doc_type", "lifecycle_status", "project"), "document_id")


def marks(docs: DataFrame, column: str) -> DataFrame:
    """(id, mark) of the documents that carry a mark."""
    return docs.where(F.col(column).isNotNull()).select("id", F.col(column).alias("mark"))


def json_members(text: Column) -> Column:
    """The members of a JSON object by key, each as a variant, so numbers, strings and nested values keep their kind."""
    return F.from_json(text, "map<string,variant>")


def json_patched(text: Column, put: Column, drop: Column) -> Column:
    """A JSON object after setting the members of the object ``put`` and removing the keys ``drop``; keys in order."""
    old, new = F.coalesce(json_members(text), json_members(F.lit("{}"))), F.coalesce(json_members(put), json_members(F.lit("{}")))
    stays = F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(new), k) & ~F.array_contains(F.coalesce(drop, F.array().cast("array<string>")), k))
    joined = F.map_concat(stays, new)
    keys = F.array_sort(F.map_keys(joined))
    return F.to_json(F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(joined, k))))


def patch_metadata(docs: DataFrame, patches: DataFrame) -> DataFrame:
    """Outcome of each patch (id, expected_version, project, put, drop, add, remove): the fields after it, or its error.

    ``put`` is a JSON object of typed fields to set, ``drop`` their keys to remove,
    ``add`` and ``remove`` are tags; a null leaves its field alone.  Errors in this
    order: not_found, version_conflict (``updated_at`` is not what the caller expects),
    drop_absent, remove_absent, add_present.  Patches do not see each other.
    """
    empty = F.array().cast("array<string>")
    rows = patches.withColumnRenamed("project", "new_project").join(docs.select("id", "updated_at", "project", "tier3", "tags"), "id", "left")
    add, remove, drop = (F.coalesce(c, empty) for c in ("add", "remove", "drop"))
    keys = F.coalesce(F.map_keys(json_members(F.col("tier3"))), empty)
    error = (
        F.when(F.col("updated_at").isNull(), "not_found").when(F.col("expected_version") != F.col("updated_at"), "version_conflict").when(F.size(F.array_except(drop, keys)) > 0, "drop_absent")
        .when(F.size(F.array_except(remove, "tags")) > 0, "remove_absent").when(F.size(F.array_intersect(add, F.array_except("tags", remove))) > 0, "add_present")
    )
    fine = error.isNull()
    tags = F.concat(F.filter("tags", lambda t: ~F.array_contains(remove, t)), F.array_distinct(add))
    return rows.select(
        "id", error.alias("error"), F.when(fine, F.coalesce("new_project", "project")).otherwise(F.col("project")).alias("project"),
        F.when(fine, json_patched(F.col("tier3"), F.col("put"), F.col("drop"))).alias("tier3"), F.when(fine, tags).otherwise(F.col("tags")).alias("tags"),
    )


def lifecycle_problems(rules: DataFrame, states: DataFrame) -> DataFrame:
    """(config, problem) of lifecycle configurations.

    ``rules`` has config, from_state, action, to_state, creates_edge; ``states`` has
    config, state, and relocated and satisfies flags.  Problems: not exactly one rule
    from (new); a rule's end that is not declared; two rules of one state and action;
    a rule from a relocated state; a supersession that makes no edge; no state that satisfies.
    """
    declared = states.select("config", F.col("state").alias("end"), F.lit(True).alias("known"), "relocated")
    ends = rules.select("config", F.explode(F.array("from_state", "to_state")).alias("end")).where("end <> '(new)'").distinct()
    configs = rules.select("config").union(states.select("config")).distinct()
    starts = rules.where("from_state = '(new)'").groupBy("config").count()
    named = lambda df, text: df.select("config", F.lit(text).alias("problem"))
    return (
        named(configs.join(starts, "config", "left").where("coalesce(count, 0) <> 1"), "not_one_start")
        .unionByName(named(ends.join(declared, ["config", "end"], "left").where("known is null"), "undeclared_state"))
        .unionByName(named(rules.groupBy("config", "from_state", "action").count().where("count > 1"), "ambiguous_rule"))
        .unionByName(named(rules.join(declared.where("relocated").select("config", F.col("end").alias("from_state")), ["config", "from_state"], "left_semi"), "leaves_relocated"))
        .unionByName(named(rules.where("action = 'supersede' and not coalesce(creates_edge, false)"), "supersede_without_edge"))
        .unionByName(named(configs.join(states.where("satisfies").select("config").distinct(), "config", "left_anti"), "nothing_satisfies"))
        .distinct()
    )


def split_malformed(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(well-formed edges, report of the others: id, reason): rows that cannot be read as edges are listed and do not stop the others."""
    reason = (
        F.when(F.col("id").isNull(), "no_id").when(F.col("source_id").isNull(), "no_source").when(F.col("edge_type").isNull(), "no_type")
        .when(F.col("target_id").isNull() & (F.col("edge_type") != "retracts"), "no_target").when((F.col("edge_type") == "retracts") & F.col("retracted_edge_id").isNull(), "retracts_nothing")
        .when(F.try_to_timestamp("created_at").isNull(), "bad_time")
    )
    judged = edges.withColumn("reason", reason)
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null").select("id", "reason")


def head_first(docs: DataFrame, positions: DataFrame) -> DataFrame:
    """Documents in the order in which a purge takes their chain, heads first: id, chain, turn.

    ``positions`` has id, chain, depth (0 at the head); documents it does not reach
    come last, by id.
    """
    rows = docs.select("id").join(positions, "id", "left")
    turn = F.row_number().over(Window.partitionBy("chain").orderBy(F.col("depth").asc_nulls_last(), "id"))
    return rows.withColumn("chain", F.coalesce("chain", "id")).withColumn("turn", turn)
