"""Centroid clustering (Lloyd's rounds in whole numbers) with ball-tree filtering.

Every task builds metric trees over the vectors it holds, ``TREE`` in one tree,
and they are written once to the shared folder.  A node stores its ball's radius,
the count and the integer sum of its vectors.  In a round a task walks its trees
with the centroids: where the triangle inequality leaves one centroid for a ball,
the ball's count and sum go to it as a whole; otherwise its halves are looked at,
and in a leaf every vector is compared exactly.  Tasks send one row per centroid
and component, so what reaches the driver is centroids x components, whatever the
input; the vectors never move after the trees are written.

Rows: vectors that are null, of another length, or hold a null or a value that is
not finite, are left out.  Components are floor(scale * x); beyond 2^40 they are
held at 2^40, as no distance between such vectors fits 64 bits, and distances and
inertias beyond 2^63 - 1 are held there.  Repeated rows are vectors like others.
Rows without an id come last where starting vectors are chosen.  With fewer vectors
than ``k``, each starts a centroid; without any there are no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import discard, materialize, ranges, release

K, DIM, ROUNDS, SCALE = 8, 64, 10, 1024
#: Vectors of a tree and of a leaf.
TREE, LEAF = 8_192, 32
_WIDE, _LONG = 1 << 40, (1 << 63) - 1
#: Sums travel as two numbers, so that adding them up never passes 64 bits.
_LIMB = 36

_TREES = "ids array<long>, points binary, sums binary, radius binary, tree binary"
_TREE_SCHEMA = pa.schema([("ids", pa.list_(pa.int64())), *((n, pa.binary()) for n in ("points", "sums", "radius", "tree"))])


def whole_vectors(table: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): the vectors that are kept, as integers."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    whole = F.transform(x, lambda c: F.floor(F.greatest(F.least(c * scale, F.lit(float(_WIDE))), F.lit(float(-_WIDE)))).cast("long"))
    return table.where(F.col("embedding").isNotNull() & (F.size(x) == dim) & finite).select("vec_id", whole.alias("v"))


class Tree:
    """Vectors in tree order, and per node: first and last vector, children, integer sum, radius."""

    def __init__(self, points: np.ndarray, sums: np.ndarray, radius: np.ndarray, tree: np.ndarray):
        self.points, self.sums, self.radius = points, sums, radius
        self.low, self.high, self.left, self.right = tree
        self.counts = self.high - self.low

    @classmethod
    def build(cls, points: np.ndarray, leaf: int = LEAF) -> tuple[Tree, np.ndarray]:
        """The tree and the order of the vectors in it."""
        order = np.arange(len(points))
        near = points.astype(np.float64)
        low, high, left, right, sums, radius = [0], [len(points)], [-1], [-1], [], []
        at = 0
        while at < len(low):
            a, b = low[at], high[at]
            own = order[a:b]
            sums.append(points[own].sum(0))
            far = np.sqrt(((near[own] - sums[-1] / (b - a)) ** 2).sum(1))
            radius.append(far.max())
            if b - a > leaf and radius[-1] > 0:
                # Halves: nearer to the vector farthest from the centre, or to the one farthest from that.
                one = near[own[far.argmax()]]
                to_one = ((near[own] - one) ** 2).sum(1)
                to_two = ((near[own] - near[own[to_one.argmax()]]) ** 2).sum(1)
                first = to_one <= to_two
                n = int(first.sum())
                if 0 < n < b - a:
                    order[a:b] = np.concatenate([own[first], own[~first]])
                    left[at], right[at] = len(low), len(low) + 1
                    low += [a, a + n]
                    high += [a + n, b]
                    left += [-1, -1]
                    right += [-1, -1]
            at += 1
        return cls(points[order], np.array(sums), np.array(radius), np.array([low, high, left, right])), order

    def row(self, ids: list) -> dict:
        tree = np.array([self.low, self.high, self.left, self.right])
        return {"ids": ids, "points": self.points.tobytes(), "sums": self.sums.tobytes(), "radius": self.radius.tobytes(), "tree": tree.tobytes()}

    @classmethod
    def of(cls, row: dict, dim: int) -> Tree:
        whole = lambda name: np.frombuffer(row[name], np.int64)
        return cls(whole("points").reshape(-1, dim), whole("sums").reshape(-1, dim), np.frombuffer(row["radius"], np.float64), whole("tree").reshape(4, -1))

    def filter(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(balls that go to one centroid as a whole, their centroids, leaves to be compared)."""
        near = centroids.astype(np.float64)
        centres = self.sums / self.counts[:, None]
        nodes, open_ = np.zeros(1, np.int64), np.ones((1, len(near)), bool)
        whole, owners, leaves = [], [], []
        while len(nodes):
            d = np.sqrt(((centres[nodes, None, :] - near) ** 2).sum(2))
            d[~open_] = np.inf
            least = d.min(1)
            # Rounding of float64 is far below a millionth of the largest distance.
            slack = 1e-6 * (1 + np.where(open_, d, 0).max(1) + self.radius[nodes])
            open_ &= d <= (least + 2 * self.radius[nodes] + slack)[:, None]
            one = open_.sum(1) == 1
            whole.append(nodes[one])
            owners.append(d[one].argmin(1))
            nodes, open_ = nodes[~one], open_[~one]
            leaf = self.left[nodes] < 0
            leaves.append(nodes[leaf])
            nodes, open_ = nodes[~leaf], open_[~leaf]
            nodes, open_ = np.concatenate([self.left[nodes], self.right[nodes]]), np.concatenate([open_, open_])
        return np.concatenate(whole), np.concatenate(owners), np.concatenate(leaves)

    def members(self, nodes: np.ndarray) -> np.ndarray:
        return ranges(self.low[nodes], self.counts[nodes])

    def add_up(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts and sums of the vectors nearest to each centroid."""
        whole, owners, leaves = self.filter(centroids)
        counts, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        np.add.at(counts, owners, self.counts[whole])
        np.add.at(sums, owners, self.sums[whole])
        at = self.members(leaves)
        for a in range(0, len(at), 4_096):
            part = self.points[at[a : a + 4_096]]
            nearest = _distances(part, centroids).argmin(1).astype(np.int64)
            np.add.at(counts, nearest, 1)
            np.add.at(sums, nearest, part)
        return counts, sums

    def assign(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest centroid of each vector and the squared distance to it."""
        whole, owners, leaves = self.filter(centroids)
        nearest, distance = np.zeros(len(self.points), np.int64), np.zeros(len(self.points), np.int64)
        nearest[self.members(whole)] = np.repeat(owners, self.counts[whole])
        at = self.members(leaves)
        for a in range(0, len(at), 4_096):
            part = at[a : a + 4_096]
            nearest[part] = _distances(self.points[part], centroids).argmin(1)
        for k in range(len(centroids)):
            own = np.flatnonzero(nearest == k)
            distance[own] = np.minimum(_distances(self.points[own], centroids[k : k + 1])[:, 0], _LONG).astype(np.int64)
        return nearest, distance


def _distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances: in float64 where that is exact, else in Python's integers."""
    largest = int(max(np.abs(points).max(initial=0), np.abs(centroids).max(initial=0)))
    if 4 * points.shape[1] * largest**2 <= 1 << 53:
        p, c = points.astype(np.float64), centroids.astype(np.float64)
        return (p * p).sum(1)[:, None] - 2 * (p @ c.T) + (c * c).sum(1)
    return ((points.astype(object)[:, None, :] - centroids.astype(object)) ** 2).sum(2)


def grow(vectors: DataFrame, dim: int = DIM, tree: int = TREE) -> DataFrame:
    """Trees over the vectors of each partition, a row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts = [], []

        def done() -> pa.RecordBatch:
            built, order = Tree.build(np.concatenate(parts))
            row = built.row([ids[k] for k in order])
            ids.clear()
            parts.clear()
            return pa.RecordBatch.from_pylist([row], schema=_TREE_SCHEMA)

        for batch in batches:
            for at in range(0, batch.num_rows, tree):
                piece = batch.slice(at, tree)
                while piece.num_rows:
                    some = piece.slice(0, tree - len(ids))
                    piece = piece.slice(some.num_rows)
                    ids += some.column(0).to_pylist()
                    parts.append(some.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim))
                    if len(ids) == tree:
                        yield done()
        if ids:
            yield done()
        release()

    return vectors.select(F.col("vec_id").cast("long"), "v").mapInArrow(run, _TREES)


def _trees(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[list, Tree]]:
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            yield row["ids"], Tree.of(row, dim)


def _next(trees: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The means of the vectors nearest to each centroid, rounded down; a centroid without vectors stays."""
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, low, high = np.zeros(k, np.int64), np.zeros((k, dim), np.int64), np.zeros((k, dim), np.int64)
        for _, tree in _trees(batches, dim):
            n, sums = tree.add_up(centroids)
            counts, low, high = counts + n, low + (sums & ((1 << _LIMB) - 1)), high + (sums >> _LIMB)
        if counts.any():
            cluster, part = np.divmod(np.arange(k * dim), dim)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (cluster, part, counts[cluster], low.ravel(), high.ravel())], ["cluster", "part", "n", "low", "high"])

    rows = trees.mapInArrow(run, "cluster long, part long, n long, low long, high long").groupBy("cluster", "part").agg(*(F.sum(c).alias(c) for c in ("n", "low", "high"))).collect()
    out = centroids.copy()
    for r in rows:  # k x dim of them
        if r["n"]:
            out[r["cluster"], r["part"]] = ((r["high"] << _LIMB) + r["low"]) // r["n"]
    return out


def start(vectors: DataFrame, k: int, prefix: str) -> np.ndarray:
    """The k vectors with the smallest hashes of prefix and id, in that order."""
    name = F.sha2(F.concat(F.lit(prefix), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.orderBy(F.col("vec_id").isNull(), name, "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def cluster(table: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, prefix: str = "3:", tree: int = TREE) -> DataFrame:
    """Per kept vector: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256."""
    spark = table.sparkSession
    vectors = whole_vectors(table, dim, scale)
    trees = materialize(grow(vectors, dim, tree), "trees")
    centroids = start(vectors, k, prefix)
    if not len(centroids):
        centroids = np.zeros((0, dim), np.int64)
    for _ in range(rounds if len(centroids) else 0):
        before, centroids = centroids, _next(trees, centroids)
        if (before == centroids).all():
            break

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, one in _trees(batches, dim):
            nearest, distance = one.assign(centroids)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(nearest.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    assigned = materialize(trees.mapInArrow(run, "vec_id long, cluster int, distance long"), "assigned")
    discard(trees)
    inertia = {r["cluster"]: int(r["d"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # k rows
    whole = min(_LONG, sum(inertia.values()))
    known = [(c, min(_LONG, d), whole, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, d in inertia.items()]
    clusters = spark.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(clusters), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
