"""Typed keys of JSON values: equal keys mean equal values of one type (1 is 1.0, "1" is not)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _variant(json: Column, key: str) -> Column:
    return F.try_variant_get(F.try_parse_json(json), f"$.{key}", "variant")


def json_type(json: Column, key: str) -> Column:
    """array, object, string, number, boolean or null; NULL if the field is absent."""
    kind = F.schema_of_variant(_variant(json, key))
    return (
        F.when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object").when(kind == "STRING", "string")
        .when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null").when(kind.isNotNull(), "number")
    )


def plain_number(text: Column) -> Column:
    """A decimal's text without trailing zeros: 1.0 and 1 are both 1."""
    short = F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(short == "-0", "0").otherwise(short)


def _key(value: Column, kind: Column) -> Column:
    text = F.try_variant_get(value, "$", "string")
    number = F.try_variant_get(value, "$", "decimal(38,10)").cast("string")
    return (
        F.when(kind == "STRING", F.concat(F.lit("s:"), text)).when(kind == "BOOLEAN", F.concat(F.lit("b:"), text))
        .when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), F.concat(F.lit("j:"), F.to_json(value))).when(kind == "VOID", None).otherwise(F.concat(F.lit("n:"), plain_number(number)))
    )


def typed_key(json: Column, key: str) -> Column:
    value = _variant(json, key)
    return _key(value, F.schema_of_variant(value))


def element_keys(json: Column, key: str) -> Column:
    """Typed keys of an array field's elements; of a scalar, the one of itself."""
    items = F.try_variant_get(_variant(json, key), "$", "array<variant>")
    each = F.transform(items, lambda v: _key(v, F.schema_of_variant(v)))
    one = typed_key(json, key)
    return F.when(json_type(json, key) == "array", F.filter(each, lambda k: k.isNotNull())).when(one.isNotNull(), F.array(one))


def facet_keys(json: Column, key: str) -> Column:
    """Facet texts of a field: element or scalar without its type, so 1, 1.0 and "1" are one value."""
    return F.transform(element_keys(json, key), lambda k: F.substring(k, 3, 2**30))


def sort_key(json: Column, key: str) -> list[Column]:
    """Columns that sort a field as JSON values: absent last, then by type, number or text."""
    typed = typed_key(json, key)
    number = F.when(typed.startswith("n:"), F.substring(typed, 3, 2**30).cast("double"))
    rank = F.when(typed.startswith("s:"), 1).when(typed.startswith("n:"), 2).when(typed.startswith("b:"), 3).otherwise(4)
    return [typed.isNull(), rank, number, typed]
