"""Browsing, paging, facets, counts and lookups over document tables."""

from __future__ import annotations

from collections.abc import Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.jsonkeys import facet_keys, sort_key
from .filters import document_filter

LIGHT = ("id", "title", "lifecycle_status", "doc_type", "tier3", "projection_scope")
FACETS = ("doc_type", "lifecycle_status", "project", "pipeline_status")
COUNTED = ("doc_type", "lifecycle_status", "project", "pipeline_status", "source_type")
SORTS = ("title", "doc_type", "document_date", "lifecycle_status")


def salience_order() -> list[Column]:
    """Active first, undated last, latest date first, then id."""
    return [F.when(F.col("lifecycle_status") == "active", 0).otherwise(1), F.col("document_date").isNull(), F.col("document_date").desc(), F.col("id")]


def sort_order(sort_by: str | None, order: str | None = "asc") -> list[Column]:
    """Order of a browse request; an unknown column sorts by title, ``tier3:field`` by typed value."""
    if sort_by is None:
        return salience_order()
    down = order == "desc"
    if sort_by.startswith("tier3:"):
        absent, *rest = sort_key(F.col("tier3"), sort_by[6:])
        return [absent, *[c.desc() if down else c for c in rest], F.col("id")]
    name = sort_by if sort_by in SORTS else "title"
    c = F.col(name)
    if name == "document_date":
        return [c.isNull(), c.desc() if down else c, F.col("id")]
    return [c.desc_nulls_first() if down else c.asc_nulls_last(), F.col("id")]


def browse(docs: DataFrame, filters: dict | None = None, limit: int = 100, offset: int = 0, sort_by: str | None = None, order: str | None = None, exclude_failed: bool = False) -> DataFrame:
    """One page, with its rank and the total of matching documents."""
    kept = docs.where(document_filter(filters, exclude_failed))
    keys = sort_order(sort_by, order)
    # The page is cut by a top-k before it is numbered, so only its rows meet in one task.
    page = kept.orderBy(*keys).limit(offset + limit).withColumn("rank", F.row_number().over(Window.orderBy(*keys))).where(F.col("rank") > offset)
    return page.join(F.broadcast(kept.agg(F.count("*").alias("total_count"))))  # a single row


def light(docs: DataFrame) -> DataFrame:
    return docs.select(*LIGHT)


def facets(docs: DataFrame, filters: dict | None = None, fields: Sequence[str] = FACETS, value_limit: int | None = 50, tier3: Sequence[str] = ()) -> DataFrame:
    """Document counts by value: field, value, doc_count, total_distinct; the top values of each field.

    All fields are counted in one aggregation.  Tags count once per document; a
    tier3 field counts each distinct element or its scalar.
    """
    kept = docs.where(document_filter(filters))
    pairs = [F.array(F.struct(F.lit(f).alias("field"), F.col(f).alias("value"))) for f in fields if f != "tags"]
    if "tags" in fields:
        pairs.append(F.transform(F.array_distinct("tags"), lambda t: F.struct(F.lit("tags").alias("field"), t.alias("value"))))
    for key in tier3:
        values = F.coalesce(F.array_distinct(facet_keys(F.col("tier3"), key)), F.array().cast("array<string>"))
        name = F.lit(f"tier3:{key}")
        pairs.append(F.transform(values, lambda v: F.struct(name.alias("field"), v.alias("value"))))  # noqa: B023
    flat = kept.select(F.explode(F.concat(*pairs)).alias("p")).where("p.value is not null")
    counts = flat.groupBy(F.col("p.field").alias("field"), F.col("p.value").alias("value")).agg(F.count("*").alias("doc_count"))
    by = Window.partitionBy("field").orderBy(F.desc("doc_count"), "value")
    ranked = counts.withColumn("rank", F.row_number().over(by)).withColumn("total_distinct", F.count("*").over(Window.partitionBy("field")))
    kept_rows = ranked if value_limit is None else ranked.where(F.col("rank") <= value_limit)
    return kept_rows.select("field", "value", "doc_count", "total_distinct")


def absent_counts(docs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Documents without any facet value for each tier3 field."""
    one = [F.count_if(F.coalesce(F.size(facet_keys(F.col("tier3"), k)), F.lit(0)) < 1).alias(k) for k in keys]
    row = docs.agg(*one)
    return row.select(F.explode(F.array(*[F.struct(F.lit(k).alias("field"), F.col(k).alias("absent_count")) for k in keys])).alias("p")).select("p.*")


def counts_by(docs: DataFrame, field: str) -> DataFrame:
    """Documents by value of an allowed field; nothing for others."""
    if field not in COUNTED or field not in docs.columns:
        return docs.where(F.lit(False)).select(F.lit("").alias("value"), F.lit(0).cast("long").alias("doc_count"))
    return docs.where(F.col(field).isNotNull()).groupBy(F.col(field).alias("value")).agg(F.count("*").alias("doc_count"))


def vault_stats(docs: DataFrame, edges: DataFrame, terminal: Sequence[str] = ("archived",)) -> DataFrame:
    """Totals and health counts as (name, value) rows, from one pass over each table."""
    live = ~F.col("lifecycle_status").isin(*terminal)
    d = docs.agg(
        F.count("*").alias("documents"), F.max("created_at").alias("last_ingestion_at"),
        F.count_if(live & (F.col("pipeline_status") == "failed")).alias("failed"),
        F.count_if(live & (F.col("pipeline_status") == "abstraction_skipped")).alias("abstraction_skipped"),
        F.count_if(live & ~F.col("metadata_confirmed")).alias("pending_metadata"),
    )
    e = edges.agg(F.count("*").alias("edges"), F.count_if(F.col("edge_type") == "retracts").alias("retractions"))
    one = d.join(F.broadcast(e))  # a single row
    names = ["documents", "last_ingestion_at", "failed", "abstraction_skipped", "pending_metadata", "edges", "retractions"]
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("string").alias("value")) for n in names])).alias("p")).select("p.*")


def principal_names(docs: DataFrame, edges: DataFrame) -> DataFrame:
    """The display name of each key: of its latest write that has a name, else NULL."""
    arms = (
        docs.select(F.col("created_by").alias("key"), F.col("created_by_name").alias("name"), F.col("created_at").alias("at"))
        .unionByName(docs.select(F.col("last_modified_by").alias("key"), F.col("last_modified_by_name").alias("name"), F.col("updated_at").alias("at")))
        .unionByName(edges.select(F.col("created_by").alias("key"), F.col("created_by_name").alias("name"), F.col("created_at").alias("at")))
    )
    latest = F.max(F.when(F.col("name").isNotNull(), F.struct(F.to_timestamp("at").alias("at"), "name")))
    return arms.where("key is not null").groupBy("key").agg(latest.alias("l")).select("key", F.col("l.name").alias("name"))


def resolve_principals(names: DataFrame, wanted: str) -> DataFrame:
    """Keys whose display name or key is the wanted one, without regard to case."""
    return names.where((F.lower("name") == wanted.lower()) | (F.col("key") == wanted)).select("key")


def nearest_names(names: DataFrame, wanted: str, most: int = 3) -> DataFrame:
    """The closest display names by edit distance, then name."""
    some = names.where("name is not null").select("name").distinct().withColumn("distance", F.levenshtein(F.lower("name"), F.lit(wanted.lower())))
    return some.orderBy("distance", "name").limit(most)


def nearest_names_by_ratio(names: DataFrame, wanted: str, most: int = 3) -> DataFrame:
    """The display names most alike by the share of characters in their longest common blocks, found one inside the other; ties by name.

    Distinct names are compared in Arrow batches, and only the first ``most`` of each task leave it.
    """

    @F.pandas_udf("double")
    def ratio(column: pd.Series) -> pd.Series:
        folded = wanted.casefold()
        return column.map(lambda name: SequenceMatcher(None, folded, name.casefold()).ratio()).astype("float64")

    some = names.where("name is not null").select("name").distinct().withColumn("ratio", ratio("name"))
    return some.orderBy(F.desc("ratio"), "name").limit(most)


def by_hashes(docs: DataFrame, hashes: DataFrame, surviving: Sequence[str]) -> DataFrame:
    """For every wanted hash: whether a document holds it, and the preferred one.

    Preferred: a surviving lifecycle, then the delivered over the stored digest,
    then the smallest id.
    """
    arms = docs.select(F.col("source_content_hash").alias("hash"), "id", "lifecycle_status", F.lit(0).alias("arm")).unionByName(
        docs.select(F.col("stored_content_hash").alias("hash"), "id", "lifecycle_status", F.lit(1).alias("arm"))
    )
    best = arms.where("hash is not null").groupBy("hash").agg(F.min(F.struct((~F.col("lifecycle_status").isin(*surviving)).alias("dead"), "arm", "id")).alias("b"))
    return hashes.select("hash").distinct().join(best, "hash", "left").select("hash", F.col("b").isNotNull().alias("exists"), F.col("b.id").alias("document_id"))


def ids_by_path(docs: DataFrame) -> DataFrame:
    """Document ids of each source path, in order."""
    return docs.groupBy("source_path").agg(F.array_join(F.sort_array(F.collect_set("id")), ",").alias("ids"), F.count("*").alias("n"))


def metadata_changes(before: DataFrame, after: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(id, field, before, after) of every field that differs, nulls told apart from values."""
    flat = lambda d, name: d.select("id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias(name)) for f in fields])).alias("p")).select("id", "p.*")
    return flat(before, "before").join(flat(after, "after"), ["id", "field"]).where(~F.col("before").eqNullSafe(F.col("after")))


def fitting_prefix(page: DataFrame, budget: int, order: str = "rank") -> DataFrame:
    """The longest prefix of a page whose rows, as JSON, fit a byte budget."""
    size = F.octet_length(F.to_json(F.struct(*page.columns))) + 1
    return page.withColumn("bytes", F.sum(size).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))).where(F.col("bytes") <= budget)


def excerpts(hits: DataFrame, cap: int) -> DataFrame:
    """Content cut to ``cap`` characters, and whether it was."""
    return hits.withColumn("cut", F.length("content") > cap).withColumn("content", F.substring("content", 1, cap))


def views(docs: DataFrame) -> DataFrame:
    """Documents by type and lifecycle with a file name each; names that collide get _2, _3 and so on."""
    stem = F.regexp_replace(F.lower("title"), "[^a-z0-9]+", "_")
    groups = docs.select("id", F.explode(F.array(F.struct(F.lit("doc_type").alias("view"), F.col("doc_type").alias("value")), F.struct(F.lit("lifecycle").alias("view"), F.col("lifecycle_status").alias("value")))).alias("p"), stem.alias("stem"))
    named = groups.where("p.value is not null").withColumn("k", F.row_number().over(Window.partitionBy("p.view", "p.value", "stem").orderBy("id")))
    return named.select("id", F.col("p.view").alias("view"), F.col("p.value").alias("value"), F.when(F.col("k") == 1, F.col("stem")).otherwise(F.concat("stem", F.lit("_"), "k")).alias("file"))
