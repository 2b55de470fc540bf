"""The order of version chains, and the order in which a purge takes them.

An edge leads from the newer document to the older one.  A linear chain is ordered
by list ranking: every document looks twice as far in each round, so a chain of n
takes log2(n) rounds of one join, whatever chains there are.  A chain with forks
is walked breadth first from its roots, a join a level, all chains at once.  The
purge order is depth first with sorted ids: on a tree it is the list ranking of
the Euler tour, again log2(n) rounds.  Only where documents of a chain have several
newer ones does the order depend on what has been visited before, document by document;
such a chain of ``MERGED`` edges at most is walked in one task, a longer one is refused
and said so.

Self-edges, repeated edges and ends that are no documents' do not count.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import discard, materialize
from .components import dealt
from .graph import chains

#: Edges of a chain with merges that one task walks.
MERGED = 1_000_000


def chain_steps(docs: DataFrame, edges: DataFrame, edge_type: str = "supersedes") -> DataFrame:
    """(s, t): distinct edges of one type between documents, from the newer to the older."""
    live = edges.where((F.col("edge_type") == edge_type) & (F.col("source_id") != F.col("target_id"))).select(F.col("source_id").alias("s"), F.col("target_id").alias("t")).distinct()
    known = docs.select("id")
    return live.join(dealt(known.withColumnRenamed("id", "s")), "s", "left_semi").join(dealt(known.withColumnRenamed("id", "t")), "t", "left_semi").select("s", "t")


def list_rank(items: DataFrame, key: str = "id") -> DataFrame:
    """(key, rank) of lists (key, next, weight): the weights from an item up to the end of its list.  ``next`` is null at the end; there are no cycles."""
    state = materialize(items.select(key, "next", F.col("weight").cast("long").alias("rank")), "ranks")
    while state.where("next is not null").limit(1).count():
        ahead = state.select(F.col(key).alias("next"), F.col("next").alias("after"), F.col("rank").alias("more"))
        last = state
        state = materialize(last.join(dealt(ahead), "next", "left").select(key, F.col("after").alias("next"), (F.col("rank") + F.coalesce("more", F.lit(0))).alias("rank")), "ranks")
        discard(last)
    return state.select(key, "rank")


def shapes(named: DataFrame, steps: DataFrame) -> DataFrame:
    """Per chain: length, roots, whether it is linear, whether some document has several newer ones, its least root and its least document."""
    newer, older = steps.groupBy(F.col("t").alias("id")).agg(F.count("*").alias("newer")), steps.groupBy(F.col("s").alias("id")).agg(F.count("*").alias("older"))
    rows = named.join(dealt(newer), "id", "left").join(dealt(older), "id", "left").select("id", "chain", F.coalesce("newer", F.lit(0)).alias("newer"), F.coalesce("older", F.lit(0)).alias("older"))
    return rows.groupBy("chain").agg(
        F.count("*").alias("length"), F.count_if(F.col("newer") == 0).alias("roots"), ((F.max("newer") <= 1) & (F.max("older") <= 1)).alias("is_linear"), (F.max("newer") > 1).alias("merges"),
        F.min(F.when(F.col("newer") == 0, F.col("id"))).alias("root"), F.min("id").alias("least"),
    )


def breadth_first(starts: DataFrame, steps: DataFrame) -> DataFrame:
    """(walk, id, place) of every document reached from the starts (walk, id): by level, the place of the first document that leads to it, id.

    The starts of a walk are its level 0, by id.  A level is one join; a walk ends
    where nothing new is reached.
    """
    level = 0
    front = starts.select("walk", "id").distinct().withColumn("n", F.row_number().over(Window.partitionBy("walk").orderBy("id")).cast("long"))
    parts = [materialize(front.withColumn("level", F.lit(level)), "level")]
    while True:
        level += 1
        seen = reduce(DataFrame.unionByName, parts).select("walk", "id")
        ahead = parts[-1].join(dealt(steps), F.col("id") == F.col("s")).groupBy("walk", "t").agg(F.min("n").alias("by")).withColumnRenamed("t", "id")
        fresh = ahead.join(dealt(seen), ["walk", "id"], "left_anti")
        numbered = fresh.withColumn("n", F.row_number().over(Window.partitionBy("walk").orderBy("by", "id")).cast("long")).drop("by")
        part = materialize(numbered.withColumn("level", F.lit(level)), "level")
        if part.isEmpty():
            break
        parts.append(part)
        if len(parts) % 8 == 0:  # few files to read again, however many levels
            parts = [materialize(reduce(DataFrame.unionByName, parts[:-1]), "levels"), parts[-1]]
    rows = reduce(DataFrame.unionByName, parts)
    before = rows.groupBy("walk", "level").agg(F.count("*").alias("size")).withColumn("before", F.coalesce(F.sum("size").over(Window.partitionBy("walk").orderBy("level").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return rows.join(dealt(before), ["walk", "level"]).select("walk", "id", (F.col("before") + F.col("n") - 1).alias("place"))


def chain_order(docs: DataFrame, edges: DataFrame, edge_type: str = "supersedes") -> DataFrame:
    """(chain, id, position, length, is_linear), oldest first (position 0).

    A chain without a root is a cycle, or is led into by one: it starts, as its newest,
    with its smallest id (see ``chain_answers`` for another start).  Documents that no root
    leads to have no position; ``length`` counts those that have one.
    """
    named, steps = _named(docs, edges, edge_type)
    return _ordered(named, steps, materialize(shapes(named, steps), "shapes"))


def _named(docs: DataFrame, edges: DataFrame, edge_type: str) -> tuple[DataFrame, DataFrame]:
    return materialize(chains(docs, edges, edge_type, dealt=True), "chains"), materialize(chain_steps(docs, edges, edge_type), "steps")


def _ordered(named: DataFrame, steps: DataFrame, shape: DataFrame) -> DataFrame:
    members = named.join(dealt(shape), "chain")
    start = F.coalesce("root", "least")
    # A linear chain as a list from its newest document; a cycle is cut before its start.
    linear = members.where("is_linear").select("id", "chain", start.alias("start"))
    next_ = steps.join(dealt(linear.select(F.col("id").alias("t"), F.col("start"))), "t").where("t <> start").select(F.col("s").alias("id"), F.col("t").alias("next"))
    ranked = list_rank(linear.select("id").join(dealt(next_), "id", "left").withColumn("weight", F.lit(1)))
    straight = linear.join(dealt(ranked), "id").join(dealt(shape.select("chain", "length")), "chain").select("chain", "id", (F.col("rank") - 1).alias("position"), "length", F.lit(True).alias("is_linear"))
    forked = members.where("not is_linear")
    newest = forked.join(dealt(steps.select(F.col("t").alias("id")).distinct()), "id", "left_anti").select(F.col("chain").alias("walk"), "id").unionByName(
        shape.where("not is_linear and roots = 0").select(F.col("chain").alias("walk"), F.col("least").alias("id"))
    )
    walked = breadth_first(newest, steps.join(dealt(forked.select(F.col("id").alias("s"))), "s", "left_semi"))
    counted = walked.groupBy("walk").agg(F.count("*").alias("length"))
    spread = walked.join(dealt(counted), "walk").select(F.col("walk").alias("chain"), "id", (F.col("length") - 1 - F.col("place")).alias("position"), "length", F.lit(False).alias("is_linear"))
    return straight.unionByName(spread)


def chain_answers(docs: DataFrame, edges: DataFrame, asked: DataFrame, edge_type: str = "supersedes", offset: int = 0, limit: int | None = None) -> DataFrame:
    """What each asked document (id) learns of its chain: query_position, head_id, tail_id, total_length, is_linear, available_edge_types and a page of ids.

    A chain without a root starts with the asked document.  A document alone learns
    which types of edges it has.  Without a limit the page is the rest of the chain, so
    the answer then grows with asked documents x chain.
    """
    named, steps = _named(docs, edges, edge_type)
    shaped = materialize(shapes(named, steps), "shapes")
    order = materialize(_ordered(named, steps, shaped), "order")
    shape = shaped.select("chain", "roots", F.col("is_linear").alias("straight"))
    who = asked.select("id").distinct().join(dealt(named), "id").join(dealt(shape), "chain").select(F.col("id").alias("asked"), "chain", "roots", "straight")
    rows = order.withColumnRenamed("id", "member")
    rooted = who.where("roots > 0").join(dealt(rows), "chain")
    # A linear cycle, turned so that the asked document comes last.
    own = order.select(F.col("id").alias("asked"), F.col("position").alias("own"))
    turned = who.where("roots = 0 and straight").join(dealt(own), "asked").join(dealt(rows), "chain").withColumn("position", (F.col("position") - F.col("own") - 1 + F.col("length")) % F.col("length")).drop("own")
    loops = who.where("roots = 0 and not straight")
    inside = steps.join(dealt(named.join(dealt(loops.select("chain").distinct()), "chain").select(F.col("id").alias("s"))), "s", "left_semi")
    walked = breadth_first(loops.select(F.col("asked").alias("walk"), F.col("asked").alias("id")), inside)
    sized = walked.join(dealt(walked.groupBy("walk").agg(F.count("*").alias("length"))), "walk")
    looped = loops.join(dealt(sized.withColumnsRenamed({"walk": "asked", "id": "member"})), "asked").withColumn("position", F.col("length") - 1 - F.col("place")).drop("place").withColumn("is_linear", F.lit(False))
    every = rooted.unionByName(turned.select(*rooted.columns)).unionByName(looped.select(*rooted.columns))
    page = (F.col("position") >= offset) & (F.lit(True) if limit is None else F.col("position") < offset + limit)
    found = every.groupBy("asked").agg(
        # A document that no root leads to stands at 0.
        F.coalesce(F.max(F.when(F.col("member") == F.col("asked"), F.col("position"))), F.lit(0)).alias("query_position"), F.max_by("member", "position").alias("head_id"), F.min_by("member", "position").alias("tail_id"),
        F.max("length").alias("total_length"), F.first("is_linear").alias("is_linear"), F.sort_array(F.collect_list(F.when(page, F.struct("position", "member")))).alias("page"),
    )
    touched = edges.select(F.explode(F.array("source_id", "target_id")).alias("asked"), F.col("edge_type").alias("type")).where("asked is not null").groupBy("asked").agg(F.sort_array(F.collect_set("type")).alias("types"))
    types = F.when(F.col("total_length") == 1, F.coalesce("types", F.array().cast("array<string>")))
    return found.join(dealt(touched), "asked", "left").select(
        F.col("asked").alias("id"), "query_position", "head_id", "tail_id", "total_length", "is_linear", types.alias("available_edge_types"), F.transform("page", lambda p: p["member"]).alias("page")
    )


def _euler_tour(steps: DataFrame, members: DataFrame) -> DataFrame:
    """(id, before): documents before each in a depth-first walk of trees, children by id; steps lead from parent to child.

    Each document is entered (``d``) and left (``u``); the tour is one list, and its rank
    over the entries tells how many come after.
    """
    child = Window.partitionBy("s").orderBy("t")
    kids = steps.withColumn("sibling", F.lead("t").over(child)).withColumn("first", F.row_number().over(child) == 1)
    mark = lambda kind, c: F.concat(F.lit(kind), F.col(c))
    first = kids.where("first").select(F.col("s").alias("id"), mark("d", "t").alias("next"))
    down = members.select("id").join(first, "id", "left").select(mark("d", "id").alias("key"), F.coalesce("next", mark("u", "id")).alias("next"), F.lit(1).alias("weight"))
    up = members.select("id").join(kids.select(F.col("t").alias("id"), F.coalesce(mark("d", "sibling"), mark("u", "s")).alias("next")), "id", "left").select(mark("u", "id").alias("key"), "next", F.lit(0).alias("weight"))
    ranked = list_rank(down.unionByName(up), "key").where("key like 'd%'").select(F.substring("key", 2, 2**31 - 1).alias("id"), "rank")
    size = members.join(ranked, "id").groupBy("tree").agg(F.max("rank").alias("size"))
    return members.join(ranked, "id").join(size, "tree").select("id", (F.col("size") - F.col("rank")).alias("before"))


def _depth_first(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """One chain with merges: (head_id, id, before) by a stack, smallest id first."""
    older: dict[str, list[str]] = {}
    for s, t in zip(frames["s"], frames["t"]):
        older.setdefault(s, []).append(t)
    head, seen, out = frames["head_id"].iloc[0], set(), []
    stack = [head]
    while stack:
        at = stack.pop()
        if at not in seen:
            seen.add(at)
            out.append(at)
            stack += sorted((t for t in older.get(at, ()) if t not in seen), reverse=True)
    return pd.DataFrame({"head_id": head, "id": out, "before": range(len(out))})


def purge_order(docs: DataFrame, edges: DataFrame, heads: DataFrame, staging: DataFrame, terminal: tuple[str, ...], edge_type: str = "supersedes", allow_branched: bool = False, merged: int = MERGED) -> DataFrame:
    """The members of the chains of named heads (head_id) in the order of a purge, heads first: head_id, id, turn, cause, refusal.

    ``cause`` is what a member itself stands against (pending_staging_edge,
    non_terminal_status).  ``refusal`` is that of the whole chain, as a chain goes
    whole or not at all: not_found, not_head, branched (unless allowed), too_branched
    (merges and more than ``merged`` edges) or members; refused before the walk, a
    head has one row without members.  Members that the head does not lead to come last, by id.
    """
    named, steps = _named(docs, edges, edge_type)
    shape = shapes(named, steps)
    weight = steps.join(named.withColumnRenamed("id", "s"), "s").groupBy("chain").agg(F.count("*").alias("steps"))
    newer = steps.select(F.col("t").alias("head_id")).distinct().withColumn("led", F.lit(True))
    asked = heads.select("head_id").distinct().join(named.withColumnRenamed("id", "head_id"), "head_id", "left").join(shape, "chain", "left").join(weight, "chain", "left").join(newer, "head_id", "left")
    why = (
        F.when(F.col("chain").isNull(), "not_found").when(F.coalesce("led", F.lit(False)), "not_head").when(~F.col("is_linear") & F.lit(not allow_branched), "branched")
        .when(F.col("merges") & (F.coalesce("steps", F.lit(0)) > merged), "too_branched")
    )
    asked = materialize(asked.select("head_id", "chain", "is_linear", "merges", "length", why.alias("refusal")), "asked")
    open_ = asked.where("refusal is null").select("head_id", "chain", "merges")
    members = materialize(named.join(open_, "chain").select("head_id", "chain", "merges", "id"), "members")
    # Chains without merges have a single head, so their documents are in one tree.
    trees = members.where("not merges").select("id", F.col("head_id").alias("tree"))
    placed = _euler_tour(steps.join(trees.select(F.col("id").alias("s")), "s", "left_semi"), trees).join(trees, "id").select(F.col("tree").alias("head_id"), "id", "before")
    tangled = steps.join(members.where("merges").select("head_id", F.col("id").alias("s")), "s").select("head_id", "s", "t")
    walked = tangled.groupBy("head_id").applyInPandas(_depth_first, "head_id string, id string, before long")
    before = placed.unionByName(walked)
    rows = members.select("head_id", "id").join(before, ["head_id", "id"], "left")
    reached = before.groupBy("head_id").agg(F.count("*").alias("reached"))
    lost = rows.where("before is null").join(reached, "head_id").withColumn("turn", F.col("reached") + F.row_number().over(Window.partitionBy("head_id").orderBy("id")) - 1).select("head_id", "id", "turn")
    turns = rows.where("before is not null").select("head_id", "id", F.col("before").alias("turn")).unionByName(lost)
    ends = staging.select(F.explode(F.array("source_id", "target_id")).alias("id")).where("id is not null").distinct().withColumn("staged", F.lit(True))
    cause = F.when(F.col("staged"), "pending_staging_edge").when(~F.col("pipeline_status").isin(*terminal) | F.col("pipeline_status").isNull(), "non_terminal_status")
    judged = materialize(turns.join(docs.select("id", "pipeline_status"), "id").join(ends, "id", "left").select("head_id", "id", "turn", cause.alias("cause")), "judged")
    stopped = judged.groupBy("head_id").agg(F.when(F.count("cause") > 0, "members").alias("refusal"))
    refused = asked.where("refusal is not null").select("head_id", F.lit(None).cast("string").alias("id"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("cause"), "refusal")
    return judged.join(stopped, "head_id").select("head_id", "id", F.col("turn").cast("long"), "cause", "refusal").unionByName(refused)
