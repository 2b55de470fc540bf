"""Document-graph tables derived from the driver's tables, by fixed rules.

``documents``, ``edges``, ``passages`` and ``vectors`` are the inputs of all graph
operators; every operator also takes any other tables of the same columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Resolution policy of each edge type (fixed values).
POLICIES = {
    "supersedes": "none",
    "retracts": "none",
    "merged_from": "none",
    "derived_from": "transitive_source",
    "references": "transitive_both",
    "covers": "transitive_both",
    "bundles_with": "transitive_both",
    "depends_on": "transitive_both",
    "instantiated_from": "transitive_both",
    "authoritative_for": "TBD",
    "sync_target": "TBD",
}
#: Document type by language (fixed values).
TYPES = {"en": "report", "de": "note", "es": "memo"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ident(n: Column) -> Column:
    return F.concat(F.lit("d"), F.lpad(n.cast("string"), 8, "0"))


def _when(pairs: dict, column: Column, default) -> Column:
    out = F
    for k, v in pairs.items():
        out = out.when(column == k, v)
    return out.otherwise(default)


def iso(minutes: Column) -> Column:
    """ISO text of so many minutes after 2024-01-01."""
    return F.date_format(F.timestamp_seconds(F.lit(1_704_067_200) + minutes * 60), "yyyy-MM-dd'T'HH:mm:ss")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document of the corpus with graph metadata; its first line stands as its abstract."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    n, sev = F.col("doc_id"), (F.col("doc_id") % 4).cast("string")
    joined = docs.join(labels, "doc_id", "left")
    name = F.concat(F.lit("User "), (n % 7).cast("string"))
    tier3 = _when(
        {0: F.concat(F.lit('{"owner":"o'), (n % 3).cast("string"), F.lit('","sev":'), sev, F.lit("}")), 1: F.concat(F.lit('{"sev":'), sev, F.lit(".0}")),
         2: F.concat(F.lit('{"sev":"'), sev, F.lit('"}')), 3: F.concat(F.lit('{"sev":['), sev, F.lit(',"x"]}')), 4: F.lit('{"sev":null}')}, n % 6, F.lit("{}"))
    return joined.select(
        ident(n).alias("id"), n.alias("n"),
        F.concat(F.lit("Src"), F.regexp_extract("source", r"(\d+)", 1), F.lit("-"), F.col("lang"), F.lit("_PartNo"), (n % 10).cast("string")).alias("title"),
        F.concat(F.lit("vault/"), F.when(n % 9 == 0, "./").otherwise(""), F.col("source"), F.lit("/doc_"), n.cast("string"), F.lit(".md")).alias("source_path"),
        F.when(n % 4 != 3, "archived").when(n % 20 == 7, "completed").otherwise("active").alias("lifecycle_status"),
        _when(TYPES, F.col("lang"), "checklist").alias("doc_type"),
        F.concat(F.lit("proj"), (n % 5).cast("string")).alias("project"),
        F.when(F.col("toxic") == 1, "failed").when(F.col("quality").isNull(), "abstraction_skipped").otherwise("abstraction_complete").alias("pipeline_status"),
        F.when(F.col("quality") == 1, "complete").otherwise("unknown").alias("projection_scope"),
        F.when(n % 7 != 0, F.date_format(F.date_add(F.lit("2023-01-01").cast("date"), (n * 37 % 700).cast("int")), "yyyy-MM-dd")).alias("document_date"),
        F.when(n % 3 != 0, iso(n * 53 % 90_000)).alias("source_modified_at"),
        F.when(n % 5 == 0, "team").when(n % 5 == 1, "").alias("authority_scope"),
        F.array("lang", "source", F.concat(F.lit("pv"), (n % 12).cast("string"))).alias("tags"),
        tier3.alias("tier3"),
        F.sha2("text", 256).alias("source_content_hash"), F.sha2(F.concat("text", F.lit("\n")), 256).alias("stored_content_hash"),
        iso(n * 37 % 100_000).alias("created_at"), F.concat(F.lit("u"), (n % 7).cast("string")).alias("created_by"), F.when(n % 3 != 0, name).alias("created_by_name"),
        F.concat(F.lit("u"), (n % 11).cast("string")).alias("last_modified_by"), F.when(n % 4 != 0, F.concat(F.lit("Editor "), (n % 11).cast("string"))).alias("last_modified_by_name"),
        iso(n * 37 % 100_000 + n % 500).alias("updated_at"), (n % 3 == 0).alias("metadata_confirmed"), F.get(F.split("text", "\n"), F.lit(0)).alias("semantic_abstract"),
        F.col("text"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed edges by arithmetic on document numbers: chains, forks, cycles, references, dependencies, retractions."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("n"))
    total = docs.agg(F.count("*").alias("total"))
    numbered = docs.join(F.broadcast(total))  # a single row
    n, t = F.col("n"), F.col("total")
    arms = [
        (n % 4 != 0, "supersedes", "s", n - 1),
        (n % 40 == 39, "supersedes", "f", n - 3),
        ((n % 80 == 76) & (n + 3 < t), "supersedes", "c", n + 3),
        ((n * 7 + 3) % t != n, "references", "r", (n * 7 + 3) % t),
        ((n % 6 == 0) & ((n * 5 + 1) % t != n), "depends_on", "p", (n * 5 + 1) % t),
        (n % 10 == 9, "retracts", "x", F.lit(None).cast("long")),
        (n % 9 == 2, "derived_from", "o", n - 2),
        (n % 15 == 4, "sync_target", "y", n - 4),
    ]
    rows = F.array(*[F.when(when, F.struct(F.lit(kind).alias("edge_type"), F.lit(mark).alias("mark"), to.alias("target"))) for when, kind, mark, to in arms])
    flat = numbered.withColumn("e", F.explode(F.filter(rows, lambda e: e.isNotNull())))
    kind, target = F.col("e.edge_type"), F.col("e.target")
    policy = _when(POLICIES, kind, "none")
    source_anchor = F.when(n % 11 == 0, ident((n + 1) % t)).otherwise(ident(n))
    return flat.select(
        F.concat(F.lit("e"), n.cast("string"), F.col("e.mark")).alias("id"), ident(n).alias("source_id"), ident(target).alias("target_id"), kind.alias("edge_type"), policy.alias("resolution_policy"),
        F.when(policy.isin("transitive_source", "transitive_both"), source_anchor).alias("source_valid_from_version"),
        F.when(policy == "transitive_both", ident(target)).alias("target_valid_from_version"),
        F.when((n % 13 == 0) & (kind == "references"), ident(n)).alias("valid_until_version"),
        F.when(kind == "retracts", F.concat(F.lit("e"), (n - 1).cast("string"), F.lit("r"))).alias("retracted_edge_id"),
        iso(n % 97 * 10).alias("created_at"),
        F.when(n % 2 == 0, "inferred:mention").otherwise("manual").alias("rationale"),
        F.concat(F.lit("u"), (n % 7).cast("string")).alias("created_by"), F.when(n % 5 != 0, F.concat(F.lit("User "), (n % 7).cast("string"))).alias("created_by_name"),
    )


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-empty lines of every document; three lines are a section."""
    docs = table(spark, sf_dir, "documents")
    n = F.col("doc_id")
    lines = docs.select(n, "source", "lang", F.posexplode(F.split("text", "\n")).alias("chunk_index", "content")).where(F.col("content") != "")
    section = F.floor(F.col("chunk_index") / 3).cast("int")
    title = F.concat(F.lit("Src"), F.regexp_extract("source", r"(\d+)", 1), F.lit("-"), F.col("lang"), F.lit("_PartNo"), (n % 10).cast("string"))
    return lines.select(ident(n).alias("document_id"), "chunk_index", section.alias("section_index"), F.concat(title, F.lit(" > S"), section.cast("string")).alias("heading_path"), "content")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors dealt to documents; ``chunk_index`` -1 marks a document surface (every fifth one)."""
    total = table(spark, sf_dir, "documents").agg(F.count("*").alias("total"))
    rows = table(spark, sf_dir, "embeddings").join(F.broadcast(total))  # a single row
    v, t = F.col("vec_id"), F.col("total")
    return rows.select(ident(v % t).alias("document_id"), F.when(v % 5 == 0, -1).otherwise(F.floor(v / t)).cast("int").alias("chunk_index"), (v % 5 == 0).alias("is_surface"), (v % 10 == 0).alias("authored"), "embedding", "vec_id")
