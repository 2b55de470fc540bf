"""Keyword and vector search, their fusion and re-ranking."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .browse import salience_order
from .filters import contains_text
from .keyword_index import KeywordIndex
from .keyword_index import search as index_search
from .passages import section_key
from .vector_index import VectorIndex
from .vector_index import search as vector_search_many

RRF_K = 60
BOOST_CUT = 100


def keyword_search(passages: DataFrame, terms: Sequence[str], limit: int | None = 10) -> DataFrame:
    """Documents that hold every term in some passage (heading or content), best first.

    A passage scores the share of terms it holds; a document its best passage.
    Columns: document_id, score, chunk_index of the best passage, matched sections
    and passages, rank.  ``limit`` counts documents; None keeps all.
    """
    terms = [t.lower() for t in terms]
    low = F.lower(F.concat_ws(" ", "heading_path", "content"))
    held = F.array(*[low.contains(t) for t in terms])
    rows = passages.where("chunk_index >= 0").select("document_id", "chunk_index", section_key().alias("section"), held.alias("held"))
    hits = F.size(F.filter("held", lambda h: h))
    scored = rows.withColumn("score", hits / F.lit(float(len(terms)))).where("score > 0")
    found = scored.groupBy("document_id").agg(
        F.max("score").alias("score"), F.min(F.struct((-F.col("score")).alias("s"), "chunk_index")).alias("best"), F.countDistinct("section").alias("matched_sections"), F.count("*").alias("matched_passages"),
        *[F.max(F.get("held", F.lit(k))).alias(f"t{k}") for k in range(len(terms))],
    )
    every = reduce(lambda a, b: a & b, [F.col(f"t{k}") for k in range(len(terms))])
    out = found.where(every).select("document_id", "score", F.col("best.chunk_index").alias("chunk_index"), "matched_sections", "matched_passages")
    return out if limit is None else ranked(out, limit)


def ranked(rows: DataFrame, limit: int, *keys: Column) -> DataFrame:
    """The first rows by score, then document, numbered from 1; only they meet in one task."""
    keys = keys or (F.desc("score"), F.asc("document_id"))
    return rows.orderBy(*keys).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*keys)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity as plain column expressions; 0 for a zero vector or other lengths, NULL without a vector."""
    d = lambda x: x.cast("double")
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: d(x) * d(y)), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + d(x) * d(x)))
    size = norm(a) * norm(b)
    return F.when(a.isNotNull() & b.isNotNull(), F.when((F.size(a) == F.size(b)) & (size > 0), dot / size).otherwise(0.0))


def vector_search(vectors: DataFrame, query: Sequence[float], limit: int = 10, arm_limit: int | None = None) -> DataFrame:
    """Nearest documents by their best passage or authored surface.

    Each arm keeps its own best ``arm_limit`` rows before they are joined, as two
    top-k cuts; rows without a score are dropped before.
    """
    arm = arm_limit or limit
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.withColumn("score", F.round(cosine(F.col("embedding"), q), 6)).where("score is not null and not isnan(score)").select("document_id", "chunk_index", "is_surface", "authored", "score")
    keys = [F.desc("score"), F.asc("document_id"), F.asc("chunk_index")]
    return _by_document(scored.where("not is_surface").orderBy(*keys).limit(arm).unionByName(scored.where("is_surface and authored").orderBy(*keys).limit(arm)), limit)


def _by_document(arms: DataFrame, limit: int) -> DataFrame:
    """Rows of both arms (document_id, chunk_index, is_surface, score) as documents: best score, nearest passage."""
    passage = F.when(~F.col("is_surface"), F.struct((-F.col("score")).alias("s"), "chunk_index"))
    found = arms.groupBy("document_id").agg(F.max("score").alias("score"), F.min(passage).alias("p"), F.count_if(~F.col("is_surface")).alias("matched_passages"))
    return ranked(found.select("document_id", "score", F.col("p.chunk_index").alias("chunk_index"), "matched_passages", F.col("p").isNull().alias("is_document_surface")), limit)


def vector_hits(passages: VectorIndex, surfaces: VectorIndex, vectors: DataFrame, query: Sequence[float], limit: int = 10, arm_limit: int | None = None, probes: int = 16, exact: bool = True) -> DataFrame:
    """``vector_search`` from an index of the passages' vectors and one of the authored surfaces'.

    Each arm takes its rows from the lists near the query, and with ``exact`` from all
    that could hold a nearer one; what the rows belong to is joined by ``vec_id``.
    """
    spark, arm = vectors.sparkSession, arm_limit or limit
    asked = spark.createDataFrame([(0, [float(x) for x in query])], "vec_id long, embedding array<double>")
    near = [vector_search_many(index, asked, arm, probes, exact).select("vec_id", "score") for index in (passages, surfaces)]
    keys = vectors.select("vec_id", "document_id", "chunk_index", "is_surface")
    return _by_document(near[0].unionByName(near[1]).join(keys, "vec_id"), limit)


def reciprocal_rank_fusion(lists: Sequence[DataFrame], limit: int = 10, k: int = RRF_K) -> DataFrame:
    """Fuse ranked lists (document_id, rank from 1): each adds 1 / (k + best rank); ties by first appearance."""
    arms = [one.groupBy("document_id").agg(F.min("rank").alias("rank")).withColumn("arm", F.lit(n)) for n, one in enumerate(lists)]
    fused = reduce(DataFrame.unionByName, arms).groupBy("document_id").agg(F.sum(1.0 / (F.lit(float(k)) + F.col("rank"))).alias("score"), F.min(F.struct("arm", "rank")).alias("first"))
    # Scores that only differ by the order of a sum are ties.
    return ranked(fused.withColumn("score", F.round("score", 12)), limit, F.desc("score"), F.asc("first"), F.asc("document_id")).drop("first")


def metadata_matches(docs: DataFrame, query: str) -> DataFrame:
    """The first ``BOOST_CUT`` documents whose title or tags hold the query, with their place from 0."""
    title, path = contains_text(F.col("title"), query), contains_text(F.col("source_path"), query)
    tags = contains_text(F.array_join("tags", " "), query)
    date = F.coalesce("document_date", F.substring("source_modified_at", 1, 10))
    keys = [F.when(title, 0).otherwise(1), F.when(path, 0).otherwise(1), F.when(F.col("lifecycle_status") == "active", 0).otherwise(1), date.isNull(), date.desc(), F.col("id")]
    cut = docs.where(title | tags).orderBy(*keys).limit(BOOST_CUT)
    return cut.withColumn("place", F.row_number().over(Window.orderBy(*keys)) - 1).select(F.col("id").alias("document_id"), "place")


def boost_metadata(hits: DataFrame, matches: DataFrame) -> DataFrame:
    """Matches score (top + 0.1, or 1 if nothing scored) less 0.001 for each place; others keep their score."""
    top = hits.agg(F.max("score").alias("top"))
    base = F.when(F.coalesce("top", F.lit(0.0)) > 0, F.col("top") + 0.1).otherwise(1.0)
    joined = hits.select("document_id", "score").join(matches, "document_id", "full").join(F.broadcast(top))  # a single row
    return joined.select("document_id", F.when(F.col("place").isNotNull(), base - 0.001 * F.col("place")).otherwise(F.col("score")).alias("score"))


def boost_abstracts(hits: DataFrame, docs: DataFrame, query: str, factor: float = 1.3) -> DataFrame:
    """Multiply the score of hits whose abstract holds the query (the first ``BOOST_CUT`` in browse order)."""
    some = docs.where(contains_text(F.col("semantic_abstract"), query)).orderBy(*salience_order()).limit(BOOST_CUT).select(F.col("id").alias("document_id"), F.lit(True).alias("boosted"))
    return hits.join(some, "document_id", "left").withColumn("score", F.when(F.col("boosted"), F.col("score") * factor).otherwise(F.col("score"))).drop("boosted")


def rerank_salience(hits: DataFrame, docs: DataFrame, as_of: str, weight: float = 0.10, half_life: float = 365.0) -> DataFrame:
    """Newer documents gain up to ``weight``; active ones come first, then score, then document."""
    date = F.to_timestamp(F.coalesce("document_date", F.substring("source_modified_at", 1, 10)))
    age = F.greatest((F.unix_micros(F.to_timestamp(F.lit(as_of))) - F.unix_micros(date)) / 86_400e6, F.lit(0.0))
    gain = F.coalesce(F.exp(-age * F.log(F.lit(2.0)) / half_life) * weight, F.lit(0.0))
    rows = hits.join(docs.select(F.col("id").alias("document_id"), "lifecycle_status", "document_date", "source_modified_at", "title"), "document_id")
    return rows.withColumn("score", F.round(F.col("score") * (1 + gain), 9)).select("document_id", "title", "lifecycle_status", "score")


def keyword_hits(index: KeywordIndex, text: str, limit: int, visible: DataFrame | None = None) -> DataFrame:
    """The keyword arm: the first documents of keyword mode by score, then id, numbered."""
    return ranked(index_search(index, text, visible).withColumn("score", F.round("score", 9)), limit)


def hybrid_search(docs: DataFrame, arms: Callable[[int], Sequence[DataFrame]], text: str, as_of: str, limit: int = 10, over_fetch: int = 5) -> DataFrame:
    """Ranked arms (vector, keyword), fused, boosted by metadata and abstract, re-ranked and paged.

    ``arms`` gives the ranked lists (document_id, rank) for a cut, which is
    limit x over-fetch x 3; the fused list is cut at limit x over-fetch.  Nothing is
    collected before the page.
    """
    fetch = limit * over_fetch
    visible = docs.where((F.col("pipeline_status") != "failed") | F.col("projection_scope").isin("limited", "complete"))
    hits = reciprocal_rank_fusion(arms(fetch * 3), fetch).join(visible.select(F.col("id").alias("document_id")), "document_id", "left_semi")
    boosted = boost_abstracts(boost_metadata(hits, metadata_matches(visible, text)), visible, text)
    scored = rerank_salience(boosted, visible, as_of)
    return ranked(scored, limit, F.when(F.col("lifecycle_status") == "active", 0).otherwise(1), F.desc("score"), F.asc("document_id"))
