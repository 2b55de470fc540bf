"""Declared fields of typed metadata, and publication under an attempt."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a field of a declared type may hold (fixed values).
SCALARS = ("string", "number", "integer", "boolean")


def field_kind(schema: Mapping, root: Mapping | None = None, depth: int = 8) -> str:
    """scalar, array (of scalars), composite (of anything else), object or mixed, of a JSON-Schema field.

    References into the same schema, nullable types, and alternatives are looked
    through; alternatives of different kinds are mixed, as is what cannot be told.
    """
    root = schema if root is None else root
    if depth == 0 or not isinstance(schema, Mapping):
        return "mixed"
    if "$ref" in schema:
        at: object = root
        for part in str(schema["$ref"]).removeprefix("#/").split("/"):
            at = at.get(part) if isinstance(at, Mapping) else None
        return field_kind(at, root, depth - 1) if isinstance(at, Mapping) else "mixed"
    for word in ("allOf", "anyOf", "oneOf"):
        if word in schema:
            kinds = {field_kind(s, root, depth - 1) for s in schema[word] if not (isinstance(s, Mapping) and s.get("type") == "null")}
            return kinds.pop() if len(kinds) == 1 else "mixed"
    types = schema.get("type", ())
    types = {types} if isinstance(types, str) else set(types)
    types.discard("null")
    if types and types <= set(SCALARS) or not types and ("enum" in schema or "const" in schema):
        return "scalar"
    if types == {"array"}:
        inner = schema.get("items")
        return "array" if inner is not None and field_kind(inner, root, depth - 1) == "scalar" else "composite"
    return "object" if types == {"object"} else "mixed"


def admits(schema: Mapping, value: object) -> bool:
    """May a scalar, or an element of an array field, of this schema be the value."""
    inner = schema.get("items", {}) if schema.get("type") == "array" else schema
    types = inner.get("type", SCALARS)
    types = [types] if isinstance(types, str) else types
    kinds = {"string": isinstance(value, str), "boolean": isinstance(value, bool), "integer": isinstance(value, int) and not isinstance(value, bool), "number": isinstance(value, (int, float)) and not isinstance(value, bool)}
    return any(kinds.get(t, value is None and t == "null") for t in types) and ("enum" not in inner or value in inner["enum"])


def fenced(key: str) -> str:
    """The key, if it may stand in a path: letters, digits and underscores only."""
    if not re.fullmatch("[A-Za-z0-9_]+", key):
        raise ValueError(f"{key!r} is no key of typed metadata")
    return key


def undeclared_keys(docs: DataFrame, declared: Mapping[str, Sequence[str]]) -> DataFrame:
    """(doc_type, key, documents, problem) of the keys that a type does not declare, or that no declaration could name."""
    keys = docs.select("doc_type", F.explode(F.json_object_keys("tier3")).alias("key"))
    known = F.array(*[F.lit(f"{t}.{fenced(k)}") for t, names in declared.items() for k in names])
    problem = F.when(~F.col("key").rlike("^[A-Za-z0-9_]+$"), "malformed").when(~F.array_contains(known, F.concat_ws(".", "doc_type", "key")), "undeclared")
    return keys.withColumn("problem", problem).where("problem is not null").groupBy("doc_type", "key", "problem").agg(F.count("*").alias("documents"))


def filtered_passages(passages: DataFrame, docs: DataFrame, visible: Column) -> DataFrame:
    """Passages of the documents that a filter lets through; an empty set of documents has none."""
    return passages.join(docs.where(visible).select(F.col("id").alias("document_id")), "document_id", "left_semi")


def delivery(docs: DataFrame, most_inline: int) -> DataFrame:
    """(id, mode, content): text in line up to so many bytes, else the path to fetch it from; containers by path in any case."""
    binary = F.lower("source_path").rlike(r"\.(docx|dotx|pdf|pptx|potx|xlsx)$")
    mode = F.when(binary, "path").when(F.octet_length("text") <= most_inline, "inline").otherwise("path")
    return docs.select("id", mode.alias("mode"), F.when(mode == "inline", F.col("text")).otherwise(F.col("source_path")).alias("content"))


def rederived(passages: DataFrame, derived: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(passages, count by document) after setting the structure of every passage under a (document_id, heading_path) to a new one (structure)."""
    new = derived.groupBy("document_id", "heading_path").agg(F.min("structure").alias("new"))
    rows = passages.join(new, ["document_id", "heading_path"], "left")
    touched = rows.where("new is not null and not (structure <=> new)").groupBy("document_id").agg(F.count("*").alias("changed"))
    return rows.withColumn("structure", F.coalesce("new", "structure")).select(*passages.columns), touched


def admitted(requests: DataFrame, tokens: int, inputs: int) -> DataFrame:
    """Requests (document_id, place, tokens) in order of place, those that a budget of tokens and of inputs admits: its columns, used, admitted.

    What comes after the first one that does not fit waits, even if it is smaller.
    """
    order = Window.partitionBy("document_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    rows = requests.withColumn("used", F.sum("tokens").over(order)).withColumn("count", F.count("*").over(order))
    return rows.withColumn("admitted", (F.col("used") <= tokens) & (F.col("count") <= inputs)).drop("count")


def published(docs: DataFrame, results: DataFrame) -> DataFrame:
    """(id, attempt, abstract, published): results (id, attempt, abstract) stand only under the document's current attempt; of several the smallest."""
    current = results.join(docs.select("id", F.col("attempt").alias("now")), "id").where("attempt = now").groupBy("id").agg(F.min("abstract").alias("new"))
    rows = docs.join(current, "id", "left")
    return rows.select("id", "attempt", F.coalesce("new", "abstract").alias("abstract"), F.col("new").isNotNull().alias("published"))


def inspected(evidence: DataFrame, generations: DataFrame) -> DataFrame:
    """Evidence (document_id, generation, hash) with whether it is current: of the latest generation and of the source as it is."""
    return evidence.join(generations, "document_id", "left").select("document_id", "generation", F.coalesce((F.col("generation") == F.col("latest")) & (F.col("hash") == F.col("source_hash")), F.lit(False)).alias("current"))


def missing_preambles(sections: DataFrame, passages: DataFrame) -> DataFrame:
    """(document_id, content): text before the first heading that no passage of the document holds yet."""
    heads = sections.where("section = 0").select("document_id", "content")
    return heads.join(passages.where("coalesce(heading_path, '') = ''").select("document_id").distinct(), "document_id", "left_anti")


def observed(docs: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """Facts of each document's kept copy before any verdict: id, present, symlink, out_of_root, same_hash (NULL where there is none to compare)."""
    rows = docs.select("id", F.col("source_path").alias("path"), F.col("source_content_hash").alias("want")).join(files, "path", "left")
    inside = F.col("resolved").startswith(root.rstrip("/") + "/")
    return rows.select("id", F.col("hash").isNotNull().alias("present"), F.coalesce(F.col("resolved") != F.col("path"), F.lit(False)).alias("symlink"), F.coalesce(~inside, F.lit(False)).alias("out_of_root"), (F.col("hash") == F.col("want")).alias("same_hash"))
