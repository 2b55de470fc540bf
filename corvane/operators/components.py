"""Connected components of an undirected graph by alternating stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import discard, materialize


def dealt(table: DataFrame) -> DataFrame:
    """The table as a side of a join that both sides are dealt for by key: whatever its size, it does not pass through the driver."""
    return table.hint("merge")


def _star(edges: DataFrame, large: bool, deal: bool = False) -> DataFrame:
    """One star step on edges (a, b) with a > b: link neighbours to the smallest of each neighbourhood."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    linked = both.join(dealt(least) if deal else least, "a")
    if large:
        out = linked.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a != b").distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether edges (a, b) are whole stars: every a has one b, and no b is an a.  Such edges are their own components."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("centre")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("centre")))
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("centre").alias("centre")).where("out > 1 or (out = 1 and centre = 1)").isEmpty()


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its component) of some edges (a, b); that node itself has none."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        p, q = root[x], root[y]
        apart = p != q
        if not apart.any():
            break
        x, y, p, q = x[apart], y[apart], p[apart], q[apart]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while not np.array_equal(root, up := root[root]):
            root = up
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


#: Edges that a task holds at once.
_HELD = 1_000_000
_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _forests(batches):
    """``forest`` of the edges that a task reads, so many at a time."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= _HELD:
            yield _contracted(held)
            held, size = [], 0
    if size:
        yield _contracted(held)


def _contracted(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(batches)
    return pa.record_batch([pa.array(x) for x in forest(*(table.column(c).to_numpy() for c in ("a", "b")))], schema=_EDGES)


def connected_components(edges: DataFrame, a: str, b: str, deal: bool = False) -> DataFrame:
    """(node, component) of every node with an edge; the component is its smallest node.

    Where nodes are longs, each task first links its own edges' nodes to the smallest they reach
    there.  Large-star and small-star steps alternate until only whole stars are left, which takes
    about log(n) rounds of aggregations and joins on narrow rows (none where one task has
    all edges); a round writes its table once, and the one before goes.  A hub's neighbours are aggregated
    before the shuffle and never gathered; its rows, joined with one row, may be
    split by Spark's skew join.  With ``deal`` no round broadcasts a table, as the driver
    would hold the small ones of every round.
    """
    pairs = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a != b").distinct()
    if {kind for _, kind in pairs.dtypes} == {"bigint"}:
        within = lambda table: table.mapInArrow(_forests, "a long, b long")
        state = materialize(within(pairs), "components")
    else:
        within = lambda table: table
        state = materialize(_star(_star(pairs, True, deal), False, deal), "components")
    while not _stars(state):
        last = state
        state = materialize(within(_star(_star(state, True, deal), False, deal)), "components")
        discard(last)
    members = state.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return members.unionByName(members.select(F.col("component").alias("node"), "component").distinct())


def joined_components(labels: DataFrame, links: DataFrame, a: str, b: str, few: int = 1_000_000) -> DataFrame:
    """``connected_components`` of the edges behind ``labels`` and further links: only components that links touch are worked on.

    Links are written tables; ends without a label are components of their own.  What changes is
    broadcast up to ``few`` counted components and joined by a shuffle beyond.  The result is a
    written table, so plans that read it do not grow with the rounds before.
    """
    one = lambda end: labels.select(F.col("node").alias(end), F.col("component").alias(f"{end}_of"))
    ends = links.select(F.col(a).alias("x"), F.col(b).alias("y")).join(one("x"), "x", "left").join(one("y"), "y", "left")
    moved = connected_components(ends.select(F.coalesce("x_of", "x").alias("x"), F.coalesce("y_of", "y").alias("y")), "x", "y")
    to = moved.select(F.col("node").alias("component"), F.col("component").alias("root"))
    old = labels.join(F.broadcast(to) if to.count() <= few else to, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
    return materialize(old.unionByName(moved.join(labels.select("node"), "node", "left_anti")), "labels")
