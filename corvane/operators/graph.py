"""Traversal, version chains and their policies over document and edge tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import materialize
from ..sources.graph_tables import POLICIES
from .components import connected_components

TRANSITIVE = ("transitive_source", "transitive_both")


def directed(edges: DataFrame, direction: str) -> DataFrame:
    """Steps (from_id, to_id, edge columns); both directions are one table, so a step is an equi-join."""
    live = edges.where("source_id is not null and target_id is not null")
    out = live.withColumn("from_id", F.col("source_id")).withColumn("to_id", F.col("target_id"))
    back = live.withColumn("from_id", F.col("target_id")).withColumn("to_id", F.col("source_id"))
    if direction == "outbound":
        return out
    if direction == "inbound":
        return back
    if direction == "both":
        return out.unionByName(back)
    raise ValueError(f"unknown direction {direction}")


def traverse(edges: DataFrame, seeds: DataFrame, direction: str = "outbound", edge_type: str | None = None, depth: int = 3) -> DataFrame:
    """All steps of at most ``depth`` from the seeds (id): start_id, id, from_id, to_id, edge_type, depth, closes.

    A step to a node that is already on its path is returned (``closes``) but not
    followed.  Each depth is one join of the frontier with the steps.
    """
    if not 1 <= depth <= 50:
        raise ValueError("depth is 1 to 50")
    steps = directed(edges if edge_type is None else edges.where(F.col("edge_type") == edge_type), direction).select("id", "from_id", "to_id", "edge_type")
    frontier = seeds.select(F.col("id").alias("start_id"), F.col("id").alias("at"), F.array("id").alias("path"))
    found: list[DataFrame] = []
    for level in range(1, depth + 1):
        joined = frontier.join(steps, F.col("at") == F.col("from_id")).withColumn("closes", F.array_contains("path", F.col("to_id")))
        if level % 4 == 0:
            joined = materialize(joined, "frontier")
        found.append(joined.select("start_id", "id", "from_id", "to_id", "edge_type", F.lit(level).alias("depth"), "closes"))
        frontier = joined.where("not closes").select("start_id", F.col("to_id").alias("at"), F.array_append("path", F.col("to_id")).alias("path"))
    return reduce(DataFrame.unionByName, found)


def first_visits(steps: DataFrame) -> DataFrame:
    """Each (start, edge) once, at its least depth."""
    return steps.groupBy("start_id", "id").agg(F.min(F.struct("depth", "from_id", "to_id", "edge_type")).alias("m")).select("start_id", "id", "m.*")


def nodes(steps: DataFrame) -> DataFrame:
    """Documents reached: least depth and number of distinct edges, by start."""
    return first_visits(steps).groupBy("start_id", F.col("to_id").alias("document_id")).agg(F.min("depth").alias("depth"), F.countDistinct("id").alias("edge_count"))


def edge_counts(steps: DataFrame) -> DataFrame:
    """Distinct edges of each type by which a document is reached."""
    return first_visits(steps).groupBy("start_id", F.col("to_id").alias("document_id"), "edge_type").agg(F.countDistinct("id").alias("edges"))


def lineage(docs: DataFrame, edges: DataFrame, edge_type: str = "supersedes", starts: DataFrame | None = None) -> DataFrame:
    """(id, ancestor): each document with itself and all it supersedes, cycles included once.

    A fixpoint on new pairs only; all documents advance in the same joins.
    """
    steps = edges.where((F.col("edge_type") == edge_type) & F.col("target_id").isNotNull()).select(F.col("source_id").alias("ancestor"), F.col("target_id").alias("next")).distinct()
    known = docs.select("id")
    base = known if starts is None else known.join(starts.select("id"), "id", "left_semi")
    fresh = materialize(base.select("id", F.col("id").alias("ancestor")), "lineage")
    parts = [fresh]
    while True:
        step = fresh.join(steps, "ancestor").select("id", F.col("next").alias("ancestor")).distinct()
        seen = reduce(DataFrame.unionByName, parts)
        fresh = materialize(step.join(seen, ["id", "ancestor"], "left_anti"), "lineage")
        if fresh.isEmpty():
            return seen
        parts.append(fresh)


def chains(docs: DataFrame, edges: DataFrame, edge_type: str = "supersedes", dealt: bool = False) -> DataFrame:
    """(id, chain): the connected component of every document over one edge type; alone, it is its own.  With ``dealt`` nothing is broadcast."""
    links = edges.where((F.col("edge_type") == edge_type) & F.col("target_id").isNotNull())
    found = connected_components(links, "source_id", "target_id", dealt).select(F.col("node").alias("id"), "component")
    return docs.select("id").join(found.hint("merge") if dealt else found, "id", "left").select("id", F.coalesce("component", "id").alias("chain"))


def chain_heads(docs: DataFrame, edges: DataFrame, edge_type: str = "supersedes", named: DataFrame | None = None) -> DataFrame:
    """(chain, heads, head_id, head_hash): heads have no inbound edge; one head makes a linear chain, else id and hash are NULL."""
    named = chains(docs, edges, edge_type) if named is None else named
    inbound = edges.where(F.col("edge_type") == edge_type).select(F.col("target_id").alias("id")).distinct()
    heads = named.join(inbound, "id", "left_anti").join(docs.select("id", "source_content_hash"), "id")
    counted = heads.groupBy("chain").agg(F.count("*").alias("heads"), F.min("id").alias("id"), F.min(F.struct("id", "source_content_hash")).alias("h"))
    one = F.col("heads") == 1
    every = named.select("chain").distinct()
    out = counted.select("chain", "heads", F.when(one, F.col("id")).alias("head_id"), F.when(one, F.col("h.source_content_hash")).alias("head_hash"))
    return every.join(out, "chain", "left").select("chain", F.coalesce("heads", F.lit(0).cast("long")).alias("heads"), "head_id", "head_hash")


def passes_anchors(rows: DataFrame, family: DataFrame) -> DataFrame:
    """Edges that their resolution policy lets through; ``family`` is (id, ancestor).

    none or NULL passes, TBD drops; transitive policies need the source (and for
    both the target) anchor in the lineage of that end.
    """
    s = family.select(F.col("id").alias("source_id"), F.col("ancestor").alias("source_valid_from_version"), F.lit(True).alias("s_ok"))
    t = family.select(F.col("id").alias("target_id"), F.col("ancestor").alias("target_valid_from_version"), F.lit(True).alias("t_ok"))
    policy = F.coalesce("resolution_policy", F.lit("none"))
    joined = rows.join(s, ["source_id", "source_valid_from_version"], "left").join(t, ["target_id", "target_valid_from_version"], "left")
    source, target = F.coalesce("s_ok", F.lit(False)), F.coalesce("t_ok", F.lit(False))
    ok = F.when(policy == "none", True).when(policy == "transitive_source", source).when(policy == "transitive_target", target).when(policy == "transitive_both", source & target).otherwise(False)
    return joined.where(ok).select(*rows.columns)


def without_retracted(rows: DataFrame, edges: DataFrame, family: DataFrame) -> DataFrame:
    """Drop transitive edges (start_id, id) that a retraction anchored in the start's lineage takes back."""
    retracts = edges.where("edge_type = 'retracts' and retracted_edge_id is not null").select(F.col("retracted_edge_id").alias("id"), F.coalesce("source_valid_from_version", "source_id").alias("ancestor"))
    gone = retracts.join(family.withColumnRenamed("id", "start_id"), "ancestor").select("start_id", "id").distinct()
    return rows.join(gone.withColumn("gone", F.lit(True)), ["start_id", "id"], "left").where(~(F.coalesce("gone", F.lit(False)) & F.coalesce("resolution_policy", F.lit("none")).isin(*TRANSITIVE))).drop("gone")


def without_tombstoned(rows: DataFrame, family: DataFrame) -> DataFrame:
    """Drop edges whose last valid version lies in the start's lineage, unless it is the start itself."""
    gone = family.select(F.col("id").alias("start_id"), F.col("ancestor").alias("valid_until_version"))
    return rows.join(gone.where("start_id != valid_until_version"), ["start_id", "valid_until_version"], "left_anti").select(*rows.columns)


def resolved_traverse(docs: DataFrame, edges: DataFrame, seeds: DataFrame, direction: str = "outbound", edge_type: str | None = None, depth: int = 1) -> DataFrame:
    """A traversal whose edges pass anchors, retractions and tombstones: start_id, id, depth and edge columns."""
    family = materialize(lineage(docs, edges), "family")
    visits = first_visits(traverse(edges, seeds, direction, edge_type, depth)).select("start_id", "id", "depth")
    rows = visits.join(edges, "id")
    return without_tombstoned(without_retracted(passes_anchors(rows, family), edges, family), family)


#: Rows that one traversal looks at over all its seeds and phases (a fixed value).
ROW_CAP = 10_000


def policy_seeds(docs: DataFrame, edges: DataFrame, starts: DataFrame, direction: str, edge_type: str | None = None) -> DataFrame:
    """(start_id, seed): where a traversal from each start begins, by the policy of its edge type.

    An end that moves with its versions is searched from the start's whole lineage, as is
    everything without a type; an end that is frozen, or has no policy, from the start alone.
    """
    policy = None if edge_type is None else POLICIES.get(edge_type, "none")
    if policy == "TBD":
        raise ValueError(f"edges of type {edge_type} have no policy yet")
    frozen = policy == "none" or policy == "transitive_source" and direction == "inbound" or policy == "transitive_target" and direction == "outbound"
    if frozen:
        return starts.select(F.col("id").alias("start_id"), F.col("id").alias("seed")).distinct()
    return lineage(docs, edges, starts=starts).select(F.col("id").alias("start_id"), F.col("ancestor").alias("seed"))


def seeded_traverse(docs: DataFrame, edges: DataFrame, starts: DataFrame, direction: str = "outbound", edge_type: str | None = None, depth: int = 1, row_cap: int = ROW_CAP) -> DataFrame:
    """Edges reached from the seeds of each start, at their least depth: start_id, id, depth, truncated.

    Both directions are an outbound phase, then an inbound one, each with its own seeds.
    ``row_cap`` is one budget of a start over its phases and seeds, spent in the order of
    phase, seed, depth and edge; ``truncated`` says that it did not suffice.
    """
    rows = []
    for turn, phase in enumerate(("outbound", "inbound") if direction == "both" else (direction,)):
        seeds = materialize(policy_seeds(docs, edges, starts, phase, edge_type), "seeds")
        visits = first_visits(traverse(edges, seeds.select(F.col("seed").alias("id")).distinct(), phase, edge_type, depth)).select(F.col("start_id").alias("seed"), "id", "depth")
        rows.append(seeds.join(visits, "seed").withColumn("phase", F.lit(turn)))
    order = Window.partitionBy("start_id").orderBy("phase", "seed", "depth", "id")
    # One row beyond the cap is looked at, and no more.
    first = reduce(DataFrame.unionByName, rows).withColumn("n", F.row_number().over(order)).where(F.col("n") <= row_cap + 1)
    marked = first.withColumn("truncated", F.max("n").over(Window.partitionBy("start_id")) > row_cap).where(F.col("n") <= row_cap)
    return marked.groupBy("start_id", "id").agg(F.min("depth").alias("depth"), F.first("truncated").alias("truncated"))


def with_retraction(edges: DataFrame, filters: dict | None = None) -> DataFrame:
    """Edges of a type, source or target, each with its earliest retraction (time, then id)."""
    kept = edges
    for name in ("source_id", "target_id", "edge_type"):
        if filters and filters.get(name):
            kept = kept.where(F.col(name) == filters[name])
    first = edges.where("edge_type = 'retracts' and retracted_edge_id is not null").groupBy("retracted_edge_id").agg(F.min(F.struct("created_at", "id")).alias("r"))
    joined = kept.join(first.withColumnRenamed("retracted_edge_id", "rid"), kept.id == F.col("rid"), "left")
    return joined.select(*kept.columns, F.col("r.id").alias("retracted_by"), F.col("r.created_at").alias("retracted_at"))


def edge_page(edges: DataFrame, filters: dict | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of edges, latest first, with rank and retraction."""
    keys = [F.desc("created_at"), F.asc("id")]
    page = with_retraction(edges, filters).orderBy(*keys).limit(offset + limit)
    return page.withColumn("rank", F.row_number().over(Window.orderBy(*keys))).where(F.col("rank") > offset)


def preconditions(docs: DataFrame, edges: DataFrame, satisfying: Sequence[str]) -> DataFrame:
    """(document_id, target_id, verdict, satisfied) of every dependency, judged on its target's chain head."""
    wants = edges.where("edge_type = 'depends_on' and target_id is not null").select(F.col("source_id").alias("document_id"), "target_id")
    named = materialize(chains(docs, edges), "chains")
    heads = chain_heads(docs, edges, named=named)
    head = docs.select(F.col("id").alias("head_id"), "lifecycle_status", "pipeline_status")
    rows = wants.join(named.select(F.col("id").alias("target_id"), "chain"), "target_id", "left").join(heads, "chain", "left").join(head, "head_id", "left")
    verdict = (
        F.when(F.col("chain").isNull(), "not found").when(F.col("heads") == 0, "cyclic").when(F.col("heads") > 1, "forked")
        .when(F.col("pipeline_status") == "failed", "failed").when(F.col("lifecycle_status").isin(*satisfying), "satisfied").otherwise("unsatisfied")
    )
    return rows.select("document_id", "target_id", verdict.alias("verdict")).withColumn("satisfied", F.col("verdict") == "satisfied")


def drift(docs: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, source_id, target_id, verdict) of live sync and derivation edges against their target's chain head.

    The recorded hash is that of the edge's target; nonlinear chains come first, a
    missing hash next, then changed content, then a chain that advanced unchanged.
    """
    live = edges.where("edge_type in ('sync_target', 'derived_from') and valid_until_version is null and target_id is not null")
    named = materialize(chains(docs, edges), "chains")
    heads = chain_heads(docs, edges, named=named)
    target = docs.select(F.col("id").alias("target_id"), F.col("source_content_hash").alias("recorded"))
    rows = live.join(named.select(F.col("id").alias("target_id"), "chain"), "target_id").join(heads, "chain").join(target, "target_id")
    verdict = (
        F.when(F.col("heads") != 1, "nonlinear").when(F.col("recorded").isNull(), "recorded_null").when(F.col("recorded") != F.col("head_hash"), "content_drift")
        .when(F.col("head_id") != F.col("target_id"), "chain_advanced_no_content_change").otherwise("current")
    )
    return rows.select("id", "source_id", "target_id", verdict.alias("verdict"))


DRIFT_VERDICTS = ("nonlinear", "recorded_null", "content_drift", "chain_advanced_no_content_change")


def drift_summary(found: DataFrame) -> DataFrame:
    """Counts of every verdict but ``current``, zeros included."""
    names = found.sparkSession.createDataFrame([(v,) for v in DRIFT_VERDICTS], "verdict string")
    return F.broadcast(names).join(found.groupBy("verdict").count(), "verdict", "left").select("verdict", F.coalesce("count", F.lit(0)).alias("edges"))


def resolution_trace(docs: DataFrame, edges: DataFrame, seeds: DataFrame, direction: str = "outbound", edge_type: str | None = None, depth: int = 1) -> DataFrame:
    """What resolution did to each visited edge: start_id, id, event (anchor_hit, anchor_miss, retracts_applied or tombstone_applied).

    An edge that the anchors let through may have a second event.
    """
    family = materialize(lineage(docs, edges), "family")
    visits = first_visits(traverse(edges, seeds, direction, edge_type, depth)).select("start_id", "id", "depth")
    rows = visits.join(edges, "id")
    hit = materialize(passes_anchors(rows, family), "anchored")
    kept = without_retracted(hit, edges, family)
    key = ["start_id", "id"]
    event = lambda df, name: df.select(*key, F.lit(name).alias("event"))
    return (
        event(hit, "anchor_hit").unionByName(event(rows.join(hit.select(*key), key, "left_anti"), "anchor_miss")).unionByName(event(hit.join(kept.select(*key), key, "left_anti"), "retracts_applied"))
        .unionByName(event(kept.join(without_tombstoned(kept, family).select(*key), key, "left_anti"), "tombstone_applied"))
    )


def capped(rows: DataFrame, most: int, *keys) -> DataFrame:
    """The first ``most`` rows by the keys, each with whether there were more: one row beyond the cap is looked at."""
    numbered = rows.orderBy(*keys).limit(most + 1).withColumn("rank", F.row_number().over(Window.orderBy(*keys)))
    truncated = F.max("rank").over(Window.partitionBy()) > most
    return numbered.withColumn("truncated", truncated).where(F.col("rank") <= most)
