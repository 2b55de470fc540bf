"""Predicates over document and edge tables, as columns."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jsonkeys import element_keys, json_type, typed_key

SCALARS = ("doc_type", "project", "lifecycle_status", "pipeline_status", "source_type")
PROVENANCE = ("created_by", "last_modified_by", "created_client", "last_modified_client", "created_by_name", "last_modified_by_name")


def not_plain(path: Column) -> Column:
    """Does a path have a part that names no folder or file: a lone dot, or nothing (but before a leading slash)."""
    parts = F.split(path, "/")
    return F.exists(parts, lambda p: p == ".") | F.exists(F.slice(parts, 2, F.size(parts)), lambda p: p == "")


def default_visible(filters: dict | None = None) -> Column:
    """Failed documents are hidden unless their projection is usable or the filter names the status."""
    if filters and filters.get("pipeline_status"):
        return F.lit(True)
    return (F.coalesce(F.col("pipeline_status"), F.lit("")) != "failed") | F.col("projection_scope").isin("limited", "complete")


def document_filter(filters: dict | None, exclude_failed: bool = False) -> Column:
    """The conjunction of all conditions a request may carry; TRUE if there are none.

    Keys: the scalar columns (an empty value is no filter), ``authority`` (non-empty
    scope), ``exclude_lifecycle``, ``ids``, ``tags`` (all of them), ``provenance``
    (column to value, list or None) and ``tier3`` (key to value or list operator).
    """
    filters = filters or {}
    parts: list[Column] = []
    if exclude_failed:
        parts.append(default_visible(filters))
    parts += [F.col(c) == filters[c] for c in SCALARS if filters.get(c)]
    if filters.get("authority"):
        parts.append(F.col("authority_scope").isNotNull() & (F.col("authority_scope") != ""))
    if filters.get("exclude_lifecycle"):
        parts.append(~F.coalesce(F.col("lifecycle_status").isin(*filters["exclude_lifecycle"]), F.lit(False)))
    if "ids" in filters:
        parts.append(F.col("id").isin(*filters["ids"]))
    parts += [F.array_contains("tags", t) for t in filters.get("tags", ())]
    for column, value in (filters.get("provenance") or {}).items():
        if column not in PROVENANCE:
            raise ValueError(f"unknown provenance field {column}")
        c = F.col(column)
        parts.append(c.isNull() if value is None else c.isin(*value) if isinstance(value, (list, tuple, set)) else c == value)
    for key, value in (filters.get("tier3") or {}).items():
        parts.append(tier3_list(key, **value) if isinstance(value, dict) else tier3_equals(key, value))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def tier3_equals(key: str, value: object) -> Column:
    """Typed equality on a metadata field.

    None: absent or JSON null.  A string compares with the field's text, so "1"
    also matches the number 1; any other value compares by type and value (1 = 1.0).
    """
    text = F.get_json_object("tier3", f"$.{key}")
    if value is None:
        return text.isNull()
    if isinstance(value, str):
        return F.coalesce(text == value, F.lit(False))
    return F.coalesce(typed_key(F.col("tier3"), key) == typed_literal(value), F.lit(False))


def typed_literal(value: object) -> str:
    """The canonical key of a Python value, as ``typed_key`` makes it of JSON."""
    if isinstance(value, bool):
        return f"b:{str(value).lower()}"
    if isinstance(value, (int, float)):
        text = format(value, "f").rstrip("0").rstrip(".") if isinstance(value, float) else str(value)
        return f"n:{text}"
    return f"s:{value}"


def tier3_list(key: str, contains: object = None, all: Sequence = (), any: Sequence = (), none: Sequence = (), doc_types: Sequence[str] = ()) -> Column:
    """List operators on an array field, within the document types that declare it.

    ``none`` keeps documents that lack the field; the others need an array.
    """
    keys = F.coalesce(element_keys(F.col("tier3"), key), F.array().cast("array<string>"))
    is_array = F.coalesce(json_type(F.col("tier3"), key) == "array", F.lit(False))
    parts: list[Column] = []
    if contains is not None:
        parts.append(is_array & F.array_contains(keys, typed_literal(contains)))
    if all:
        parts.append(is_array & F.forall(F.array(*[F.lit(typed_literal(v)) for v in all]), lambda v: F.array_contains(keys, v)))
    if any:
        parts.append(is_array & F.arrays_overlap(keys, F.array(*[F.lit(typed_literal(v)) for v in any])))
    if none:
        parts.append(~(is_array & F.arrays_overlap(keys, F.array(*[F.lit(typed_literal(v)) for v in none]))))
    if doc_types:
        parts.append(F.col("doc_type").isin(*doc_types))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def in_scope(scope: str, ids: Iterable[str] = (), filters: dict | None = None) -> Column:
    """The scope gate: all, authoritative, specific (needs ids) or filtered (needs filters)."""
    if scope == "all":
        return F.lit(True)
    if scope == "authoritative":
        return F.col("authority_scope").isNotNull() & (F.col("authority_scope") != "")
    if scope == "specific":
        if not (ids := list(ids)):
            raise ValueError("a specific scope needs document ids")
        return F.col("id").isin(*ids)
    if scope == "filtered":
        if not filters:
            raise ValueError("a filtered scope needs filters")
        return document_filter(filters)
    raise ValueError(f"unknown scope {scope}")


def relevant(min_relevance: float | None) -> Column:
    """Drop scored rows below the threshold; unscored ones stay."""
    return F.lit(True) if min_relevance is None else F.col("score").isNull() | (F.col("score") >= min_relevance)


def escape_like(value: str) -> str:
    return value.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def contains_text(column: Column, value: str) -> Column:
    """Case-insensitive literal substring."""
    return column.ilike(f"%{escape_like(value)}%")


def under_heading(prefix: str) -> Column:
    """A heading and everything below it."""
    return (F.col("heading_path") == prefix) | F.col("heading_path").startswith(f"{prefix} > ")


def ingested_between(docs: DataFrame, since: str, until: str | None = None) -> DataFrame:
    """Half-open window on the creation time, in order of time and id."""
    keep = F.col("created_at") >= since
    return docs.where(keep if until is None else keep & (F.col("created_at") < until)).orderBy("created_at", "id")


def longer_than(passages: DataFrame, bound: int) -> DataFrame:
    """Documents with a passage of more bytes than the bound, heading included."""
    return passages.where(F.octet_length("heading_path") + F.octet_length("content") > bound).select("document_id").distinct()


def pending_metadata(docs: DataFrame, exclude_lifecycle: Sequence[str] = (), limit: int = 10, offset: int = 0) -> DataFrame:
    """Documents whose metadata nobody confirmed, a page in id order."""
    return docs.where(~F.col("metadata_confirmed") & document_filter({"exclude_lifecycle": exclude_lifecycle})).orderBy("id").offset(offset).limit(min(limit, 100))
