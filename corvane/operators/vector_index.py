"""An inverted-file index of vectors: lists around centres, probes, and an exact way.

Centres come from k-means on a bounded sample (``SAMPLE`` rows, by the smallest
hashes); every row of the table is then assigned to its nearest centre and kept,
as a unit vector, in a block of its list (at most ``BLOCK`` vectors).  Blocks are
range-partitioned by list, so a large list is many files, and a filter on ``list``
reaches the Parquet scan.

Lists are dealt to parts of a bounded size, and a query goes once to each part that
has lists it probes: there a matrix product gives all cosines of a block and the queries
that ask its list, and only the best ``k`` of a query and part leave the task.  The probes are approximate.  The exact way takes the k-th
best score of the probes, and visits the lists that could hold a better one: by the
triangle inequality on angles, none of list l is nearer to q than
angle(q, centre) - radius(l).

Rows without a vector, of another length, with a value that is null or not finite,
or of length zero are in no list: they have no direction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.lineage import fresh_path

#: Rows that k-means sees, lists at most, and vectors of a block.
SAMPLE, LISTS, BLOCK = 16_384, 1_024, 1_024
#: Queries that meet a block at once, and that are dealt to lists at once; vectors that a task holds at once.
QUERIES, DEALT, PART = 512, 64, 32_768
#: Scores are compared after rounding to so many digits; ties go to the smaller id.
DIGITS = 6

_BLOCKS = "list int, ids array<long>, unit binary"
_BLOCK_SCHEMA = pa.schema([("list", pa.int32()), ("ids", pa.list_(pa.int64())), ("unit", pa.binary())])


@dataclass(frozen=True)
class VectorIndex:
    """Blocks (list, ids, unit vectors); centres (lists x dim), the angle to the farthest vector of each list, and its vectors' number."""

    blocks: DataFrame
    centres: np.ndarray
    radius: np.ndarray
    sizes: np.ndarray | None = None

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> VectorIndex:
        rows = spark.read.parquet(f"{path}/lists").orderBy("list").collect()  # at most LISTS
        return cls(spark.read.parquet(f"{path}/blocks"), np.array([r["centre"] for r in rows], np.float64), np.array([r["radius"] for r in rows]), np.array([r["size"] for r in rows], np.int64))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _units(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(1))[:, None]


def directed(vectors: DataFrame, dim: int) -> DataFrame:
    """(vec_id, v): the rows that have a direction."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size(v) == dim) & finite & F.exists(v, lambda x: x != 0)).select(F.col("vec_id").cast("long"), v.alias("v"))


def centres_of(sample: np.ndarray, lists: int, rounds: int = 12, seed: int = 17) -> np.ndarray:
    """Spherical k-means of a bounded sample of unit vectors."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), lists, replace=False)]
    for _ in range(rounds):
        nearest = np.concatenate([(sample[a : a + BLOCK] @ centres.T).argmax(1) for a in range(0, len(sample), BLOCK)])
        sums = np.stack([np.bincount(nearest, sample[:, d], lists) for d in range(sample.shape[1])], 1)
        size = np.sqrt((sums * sums).sum(1))
        centres = np.where(size[:, None] > 0, sums / np.where(size > 0, size, 1)[:, None], centres)
    return centres


def _sampled(rows: DataFrame, total: int, dim: int, sample: int) -> np.ndarray:
    """Unit vectors of the rows with the smallest hashes, at most ``sample``.

    Hashes under a limit that somewhat more rows are expected to pass are taken first: a cut by
    order alone has every task send that many rows to the driver.
    """
    keyed = rows.select(F.xxhash64("vec_id", "v").alias("h"), "vec_id", "v")
    share = 1.2 * sample / total if total > sample else 1.0
    while True:
        some = keyed if share >= 1 else keyed.where(F.col("h") <= int(-(2**63) + share * 2**64))
        if share >= 1 or some.count() >= sample:
            break
        share *= 2
    # Numbered after they are few, so that the driver gets ``sample`` rows once.
    few = some.repartition(1).sortWithinPartitions("h", "vec_id").limit(sample).select("v").toArrow()
    return _units(_matrix(few.column(0).combine_chunks(), dim)) if few.num_rows else np.zeros((0, dim))


def build(vectors: DataFrame, dim: int, lists: int | None = None, path: str | None = None, sample: int = SAMPLE) -> VectorIndex:
    """Write the index of vectors (vec_id, embedding); by default a list for every 100 rows, ``LISTS`` at most."""
    spark = vectors.sparkSession
    path = path or fresh_path(spark, "vectors")
    rows = directed(vectors, dim)
    total = rows.count()
    if lists is None:
        lists = min(LISTS, max(1, total // 100))
    some = _sampled(rows, total, dim, sample)
    centres = centres_of(some, min(lists, len(some))) if len(some) else np.zeros((0, dim))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cos = _units(_matrix(batch.column(1), dim)) @ centres.T
            nearest = cos.argmax(1)
            angle = np.arccos(np.clip(cos[np.arange(len(cos)), nearest], -1, 1))
            yield pa.RecordBatch.from_arrays([pa.array(nearest.astype(np.int32)), batch.column(0), batch.column(1), pa.array(angle)], ["list", "vec_id", "v", "angle"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, parts, radius = -1, [], [], 0.0

        def block() -> pa.RecordBatch:
            row = {"list": at, "ids": list(ids), "unit": np.concatenate(parts).astype("<f8").tobytes(), "radius": radius}
            ids.clear()
            parts.clear()
            return pa.RecordBatch.from_pylist([row], schema=_BLOCK_SCHEMA.append(pa.field("radius", pa.float64())))

        for batch in batches:
            number = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(number[1:] != number[:-1]) + 1).tolist(), len(number)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if ids and at != number[a]:
                    yield block()
                    radius = 0.0
                at = int(number[a])
                while a < b:
                    piece = batch.slice(a, min(b - a, BLOCK - len(ids)))
                    a += piece.num_rows
                    ids += piece.column(1).to_pylist()
                    parts.append(_units(_matrix(piece.column(2), dim)))
                    radius = max(radius, float(piece.column(3).to_numpy().max()))
                    if len(ids) == BLOCK:
                        yield block()
                        radius = 0.0
        if ids:
            yield block()

    assigned = rows.mapInArrow(assign, "list int, vec_id long, v array<double>, angle double")
    ordered = assigned.repartitionByRange("list", "vec_id").sortWithinPartitions("list", "vec_id")
    ordered.mapInArrow(pack, f"{_BLOCKS}, radius double").write.parquet(f"{path}/blocks")
    filled = {r["list"]: (r["r"], r["n"]) for r in spark.read.parquet(f"{path}/blocks").groupBy("list").agg(F.max("radius").alias("r"), F.sum(F.size("ids")).alias("n")).collect()}  # at most LISTS
    known = [(k, centres[k].tolist(), *filled.get(k, (-1.0, 0))) for k in range(len(centres))]
    spark.createDataFrame(known, "list int, centre array<double>, radius double, size long").coalesce(1).write.parquet(f"{path}/lists")
    return VectorIndex.load(spark, path)


def _pieces(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``most`` rows: what is made of a row may be as large as a list of all lists or two blocks."""
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            yield batch.slice(at, most)


def _probes(index: VectorIndex, queries: DataFrame, probes: int) -> DataFrame:
    """(list, query_id, q): each query with its nearest lists."""
    centres, dim = index.centres, index.centres.shape[1]
    filled = index.radius >= 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches, DEALT):
            cos = _units(_matrix(batch.column(1), dim)) @ centres.T
            cos[:, ~filled] = -2
            near = np.argsort(-cos, 1, kind="stable")[:, :probes]
            row, place = np.nonzero(filled[near])
            yield pa.RecordBatch.from_arrays([pa.array(near[row, place].astype(np.int32)), batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row))], ["list", "query_id", "q"])

    return queries.mapInArrow(run, "list int, query_id long, q array<double>")


def _others(index: VectorIndex, queries: DataFrame, probes: int) -> DataFrame:
    """(list, query_id, q) of queries (query_id, q, kth): lists beyond the probes that could hold a vector better than the k-th."""
    centres, radius, dim = index.centres, index.radius, index.centres.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches, DEALT):
            cos = _units(_matrix(batch.column(1), dim)) @ centres.T
            best = np.cos(np.maximum(0, np.arccos(np.clip(cos, -1, 1)) - radius))
            cos[:, radius < 0] = -2
            seen = np.argsort(-cos, 1, kind="stable")[:, :probes]
            # As scores are rounded, one that is less by a last digit may still be equal.
            kth = batch.column(2).to_numpy(zero_copy_only=False)
            open_ = (best >= kth[:, None] - 2 * 10.0**-DIGITS) & (radius >= 0)
            np.put_along_axis(open_, seen, False, 1)
            row, number = np.nonzero(open_)
            yield pa.RecordBatch.from_arrays([pa.array(number.astype(np.int32)), batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row))], ["list", "query_id", "q"])

    return queries.mapInArrow(run, "list int, query_id long, q array<double>")


def _parts(index: VectorIndex, cores: int) -> tuple[np.ndarray, np.ndarray]:
    """For each list the first of its parts, and how many they are: short lists share a part, a long one has several.

    A part has about ``PART`` vectors at most, fewer where that would leave cores idle.
    """
    quota = max(BLOCK, min(PART, -(-int(index.sizes.sum()) // (4 * cores))))
    first, spread = np.zeros(len(index.sizes), np.int64), np.maximum(1, -(-index.sizes // quota))
    parts, shared, room = 0, 0, 0
    for number, size in enumerate(index.sizes.tolist()):
        if spread[number] > 1:
            first[number], parts = parts, parts + int(spread[number])
            continue
        if size > room:
            shared, room, parts = parts, quota, parts + 1
        first[number], room = shared, room - size
    return first, spread


def _of(values: np.ndarray, place: Column) -> Column:
    """The value at a place, of at most ``LISTS`` values that are written into the plan as one literal."""
    return F.get(F.split(F.lit(",".join(map(str, values.tolist()))), ",").cast("array<int>"), place)


def _scan(index: VectorIndex, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): the best k of each query in each part of the index that holds lists it asks.

    A query goes to a part once, with the lists it asks there, and no table of queries or vectors is broadcast: Spark
    takes rows that Arrow batches make for small ones, whatever is in them.
    """
    dim, spark = index.centres.shape[1], asked.sparkSession
    first, spread = _parts(index, spark.sparkContext.defaultParallelism)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches, LISTS):
            if not batch.num_rows:
                continue
            number, ids, unit = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _units(_matrix(batch.column(2), dim))
            # Rows of a query stand together; another one of the same id is another query.
            query = np.append(0, np.cumsum((ids[1:] != ids[:-1]) | (unit[1:] != unit[:-1]).any(1)))
            times = spread[number]
            row = np.repeat(np.arange(len(number)), times)
            part = first[number][row] + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            order = np.lexsort((part, query[row]))
            row, part = row[order], part[order]
            starts = np.flatnonzero(np.append(True, (part[1:] != part[:-1]) | (query[row][1:] != query[row][:-1])))
            one, n = row[starts], len(starts)
            lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(row)).astype(np.int32)), pa.array(number[row].astype(np.int32)))
            units = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * 8 * dim).astype(np.int32)), pa.py_buffer(unit[one].astype("<f8").tobytes())])
            own = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32)), pa.array(ids[one]))
            yield pa.RecordBatch.from_arrays([pa.array(part[starts].astype(np.int32)), pa.array(np.ones(n, bool)), lists, own, units], ["part", "asks", "lists", "ids", "unit"])

    def best(held: list[tuple[int, np.ndarray, np.ndarray]], queries: pa.RecordBatch) -> pa.RecordBatch:
        q = np.frombuffer(b"".join(queries.column(4).to_pylist()), "<f8").reshape(-1, dim)
        lists = queries.column(2)
        wanted, row = lists.flatten().to_numpy(), np.repeat(np.arange(len(q)), lists.value_lengths().to_numpy())
        order = np.argsort(wanted, kind="stable")
        wanted, row = wanted[order], row[order]
        low = np.full(len(q), -np.inf)
        owner, found, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for number, ids, v in held:
            who = row[np.searchsorted(wanted, number) : np.searchsorted(wanted, number, "right")]
            if not len(who):
                continue
            cos = q[who] @ v.T
            at, place = np.nonzero(cos >= low[who][:, None] - 10.0**-DIGITS)
            owner, found, score = np.append(owner, who[at]), np.append(found, ids[place]), np.append(score, np.round(cos[at, place], DIGITS) + 0.0)
            # By query, falling score and rising id; the first k of each stay.
            order = np.lexsort((found, -score, owner))
            sorted_ = owner[order]
            rank = np.arange(len(order)) - np.searchsorted(sorted_, sorted_)
            order, last = order[rank < k], order[rank == k - 1]
            low[owner[last]] = score[last]
            owner, found, score = owner[order], found[order], score[order]
        return pa.RecordBatch.from_arrays([queries.column(3).flatten().take(pa.array(owner)), pa.array(found), pa.array(score)], ["query_id", "vec_id", "score"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = -1, []
        for batch in batches:
            part, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.append(part[1:] != part[:-1], True)).tolist() if len(part) else []
            a = 0
            for b in (e + 1 for e in edges):
                if part[a] != at:
                    at, held = int(part[a]), []
                mid = a + int((~asks[a:b]).sum())
                for one in range(a, mid):
                    held.append((batch.column(2)[one].values[0].as_py(), batch.column(3)[one].values.to_numpy().copy(), np.frombuffer(batch.column(4)[one].as_py(), "<f8").reshape(-1, dim)))
                for some in range(mid, b, QUERIES):
                    yield best(held, batch.slice(some, min(QUERIES, b - some)))
                a = b

    part = _of(first, F.col("list")) + F.pmod(F.xxhash64(F.get("ids", F.lit(0))), _of(spread, F.col("list")))
    blocks = index.blocks.select(part.cast("int").alias("part"), F.lit(False).alias("asks"), F.array("list").alias("lists"), "ids", "unit")
    both = blocks.unionByName(asked.mapInArrow(deal, "part int, asks boolean, lists array<int>, ids array<long>, unit binary"))
    # Blocks of a part come before its queries.
    return both.repartition(int((first + spread).max()), "part").sortWithinPartitions("part", "asks").mapInArrow(meet, "query_id long, vec_id long, score double")


def search(index: VectorIndex, queries: DataFrame, k: int = 10, probes: int = 16, exact: bool = False) -> DataFrame:
    """The k nearest vectors of every query (vec_id, embedding) by cosine: query_id, rank, vec_id, score.

    ``probes`` lists are searched for each query; with ``exact`` also every list that
    could hold a better vector, so that the result is that of a search through all.
    """
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    numbered = lambda rows: rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    if not len(index.centres):
        return queries.select(F.col("vec_id").cast("long").alias("query_id"), F.lit(0).alias("rank"), F.lit(0).cast("long").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    asked = directed(queries, index.centres.shape[1]).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    found = numbered(_scan(index, _probes(index, asked, probes), k))
    if exact:
        kth = found.groupBy("query_id").agg(F.min(F.when(F.col("rank") == k, F.col("score"))).alias("kth"))
        held = asked.join(kth, "query_id", "left").select("query_id", "q", F.coalesce("kth", F.lit(-2.0)).alias("kth"))
        more = _scan(index, _others(index, held, probes), k)
        found = numbered(found.drop("rank").unionByName(more))
    return found.select("query_id", "rank", "vec_id", "score")


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Per query, the share of its true neighbours (query_id, vec_id) that were found."""
    hits = truth.join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return hits.groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("recall"))


def probes_for(index: VectorIndex, vectors: DataFrame, k: int = 10, target: float = 0.95, most: int = 256) -> int:
    """The fewest probes whose lists hold ``target`` of the true k nearest vectors, over a sample of at most ``most`` queries."""
    dim = index.centres.shape[1]
    some = directed(vectors, dim).orderBy(F.xxhash64("vec_id"), "vec_id").limit(most)
    truth = search(index, some.select("vec_id", F.col("v").alias("embedding")), k, exact=True)
    listed = index.blocks.select("list", F.explode("ids").alias("vec_id"))
    rows = truth.join(listed, "vec_id").groupBy("query_id").agg(F.collect_list("list").alias("lists")).join(some.withColumnRenamed("vec_id", "query_id"), "query_id").collect()  # at most ``most`` of them
    places = []
    for r in rows:
        cos = _units(np.array([r["v"]])) @ index.centres.T
        cos[:, index.radius < 0] = -2
        place = np.empty(len(index.centres), np.int64)
        place[np.argsort(-cos[0], kind="stable")] = np.arange(len(index.centres))
        places += place[r["lists"]].tolist()
    return 1 + int(np.quantile(places, target, method="higher")) if places else 1
