"""Retrieval quality and latency metrics over ranked lists.

Rankings are tables (query, document_id, rank from 1); judgements (query,
document_id, grade).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlap_at_k(a: Column, b: Column, k: int) -> Column:
    """Shared items of two lists' first k, over k even for shorter lists."""
    if k <= 0:
        raise ValueError("k must be positive")
    return F.size(F.array_intersect(F.slice(a, 1, k), F.slice(b, 1, k))) / F.lit(float(k))


def rank_biased_overlap(a: Column, b: Column, p: float = 0.9) -> Column:
    """Extrapolated rank-biased overlap of two lists without repeats; 1 if both are empty."""
    depth = F.greatest(F.size(a), F.size(b))
    shared = lambda d: F.size(F.array_intersect(F.slice(a, 1, d), F.slice(b, 1, d))) / d
    total = F.aggregate(F.sequence(F.lit(1), depth), F.lit(0.0), lambda s, d: s + shared(d) * F.pow(F.lit(p), d))
    return F.when(depth == 0, 1.0).otherwise(shared(depth) * F.pow(F.lit(p), depth) + total * (1 - p) / p)


def lists(ranking: DataFrame) -> DataFrame:
    """One array of documents per query, in rank order."""
    return ranking.groupBy("query").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "document_id"))), lambda r: r["document_id"]).alias("documents"))


def relevance(ranking: DataFrame, judged: DataFrame, k: int = 10) -> DataFrame:
    """query, ndcg, reciprocal_rank and success at k, of every judged query."""
    found = judged.join(ranking.where(F.col("rank") <= k), ["query", "document_id"], "left").where("grade > 0")
    ideal = Window.partitionBy("query").orderBy(F.desc("grade"), "document_id")
    rows = found.withColumn("place", F.row_number().over(ideal))
    gain = lambda r: F.col("grade") / (F.log(r + 1.0) / F.log(F.lit(2.0)))
    sums = rows.groupBy("query").agg(F.sum(F.when(F.col("rank").isNotNull(), gain(F.col("rank")))).alias("dcg"), F.sum(F.when(F.col("place") <= k, gain(F.col("place")))).alias("best"), F.min("rank").alias("first"))
    return sums.select("query", F.round(F.coalesce(F.col("dcg") / F.col("best"), F.lit(0.0)), 9).alias("ndcg"), F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 9).alias("reciprocal_rank"), F.col("first").isNotNull().cast("int").alias("success"))


def recommend_fidelity(fused: float, raw: float, native: float = 0.90, escalate: float = 0.75) -> str:
    """native, judge or escalate, by the worse of two mean overlaps."""
    worst = min(fused, raw)
    return "native" if worst >= native else "escalate" if worst < escalate else "judge"


def recommend_relevance(gap: float, close: float = 0.05, far: float = 0.10) -> str:
    return "equivalent" if gap <= close else "worse" if gap > far else "judge"


def retrieval_assertions(ranking: DataFrame, asserted: DataFrame, top_k: int = 10) -> DataFrame:
    """query, document_id, passed, and the rank if it is within min(5 k, 100)."""
    near = ranking.where(F.col("rank") <= min(5 * top_k, 100))
    return asserted.join(near, ["query", "document_id"], "left").select("query", "document_id", (F.coalesce("rank", F.lit(2**30)) <= top_k).alias("passed"), "rank")


def latency(rows: DataFrame, key: str, value: str, small: int = 1_000) -> DataFrame:
    """Count, min, median, max and p95 by nearest rank and by interpolation, of each key.

    Exact, and no group is gathered: approximate percentiles bracket the ranks that
    are wanted, the values below each bracket are counted, and only those inside
    (about two in a hundred; all of a group of at most ``small``) are put in order.
    """
    held = rows.where(F.col(value).isNotNull()).select(F.col(key).alias("k"), F.col(value).alias("v"))
    near = F.percentile_approx("v", F.array(*map(F.lit, (0.49, 0.51, 0.94, 0.96))), F.lit(10_000))
    bounds = held.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), near.alias("b"))
    edge = lambda j, end: F.when(F.col("n") <= small, F.col(end)).otherwise(F.get("b", F.lit(j)))
    brackets = bounds.select("k", F.explode(F.array(
        F.struct(F.lit(0.5).alias("q"), edge(0, "least").alias("low"), edge(1, "most").alias("high")), F.struct(F.lit(0.95).alias("q"), edge(2, "least").alias("low"), edge(3, "most").alias("high")),
    )).alias("x")).select("k", "x.*")
    met = held.join(brackets, "k")
    below = met.groupBy("k", "q").agg(F.count_if(F.col("v") < F.col("low")).alias("below"))
    inside = met.where("v between low and high").withColumn("place", F.row_number().over(Window.partitionBy("k", "q").orderBy("v")))
    at = inside.join(below, ["k", "q"]).join(bounds.select("k", "n"), "k").withColumn("rank", F.col("place") + F.col("below"))
    spot = (F.col("n") - 1) * F.col("q")
    first = F.floor(spot) + 1
    found = at.groupBy("k", "q").agg(
        F.max(F.when(F.col("rank") == first, F.col("v"))).alias("one"), F.max(F.when(F.col("rank") == first + 1, F.col("v"))).alias("two"),
        F.max(spot - F.floor(spot)).alias("part"), F.max(F.when(F.col("rank") == F.ceil(F.col("n") * F.col("q")), F.col("v"))).alias("nearest"),
    ).withColumn("between", F.round(F.col("one") + F.col("part") * (F.coalesce("two", "one") - F.col("one")), 6))
    pick = lambda q, c: F.max(F.when(F.col("q") == q, F.col(c)))
    wide = found.groupBy("k").agg(pick(0.5, "between").alias("median"), pick(0.95, "between").alias("p95_interpolated"), pick(0.95, "nearest").alias("p95_nearest"))
    return bounds.join(wide, "k").select(F.col("k").alias(key), "n", "least", "most", "median", "p95_interpolated", "p95_nearest")


def stratified_sample(rows: DataFrame, cell: list[str], ident: str, target: int, seed: int = 42) -> DataFrame:
    """Round-robin over cells in a seeded order until ``target`` rows."""
    inside = F.xxhash64(F.lit(seed), F.col(ident).cast("string"))
    placed = rows.withColumn("turn", F.row_number().over(Window.partitionBy(*cell).orderBy(inside, ident)))
    return placed.where(F.col("turn") <= target).orderBy("turn", F.xxhash64(F.lit(seed), *[F.col(c).cast("string") for c in cell]), ident).limit(target)


def length_terciles(rows: DataFrame, length: str) -> Column:
    """0, 1 or 2 by the exact terciles of a length."""
    low, high = rows.agg(F.percentile(length, [1 / 3, 2 / 3])).first()[0]
    return F.when(F.col(length) <= low, 0).when(F.col(length) <= high, 1).otherwise(2)
