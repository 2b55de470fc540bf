"""Metadata from file names as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import format_version

#: A longer name is its own title (fixed value).
LONGEST = 1024
#: A date at the start, copy noise at the end, and a version with an optional upper-case note (fixed patterns).
DATE = r"^(\d{4}-\d{2}-\d{2})[_ ](.*)$"
NOISE = r"([_ ]+(copy(\s+\d+)?|\(\d+\)))+\s*$"
VERSION = r"(^|[_ ])([vV]\d+([._]\d+)*)((_[A-Z]+)*)$"
#: Source types by file extension (fixed values); mail and chat types have no reader.
EXTENSIONS = {
    "markdown": ("md", "markdown"), "text": ("txt",), "json": ("json", "jsonl"), "yaml": ("yaml", "yml"), "toml": ("toml",), "xml": ("xml",), "delimited": ("csv", "tsv"),
    "docx": ("docx", "dotx"), "pdf": ("pdf",), "pptx": ("pptx", "potx"), "xlsx": ("xlsx",),
}


def source_type(path: Column) -> Column:
    """The source type of a path by its extension, in any case; NULL for one that no reader knows."""
    extension = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    out = F
    for name, endings in EXTENSIONS.items():
        out = out.when(extension.isin(*endings), name)
    return out


def stem_of(path: Column) -> Column:
    """A path's last part without its extension."""
    return F.regexp_replace(F.regexp_extract(path, "([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def decision_number(stem: Column) -> Column:
    """The three digits of a decision record's name; NULL for other names."""
    found = F.regexp_extract(F.lower(stem), r"^cas-adr-(\d{3})_", 1)
    return F.when(found != "", found)


def _starts(prefix: str):
    return lambda code: F.upper(code).startswith(prefix.upper())


def parsed_names(
    rows: DataFrame, stem: str, code_patterns: Sequence[str] = (), project_id: str | None = None, separator: str = "_",
    keywords: Sequence[tuple[str, str]] = (), codes_to_type: Sequence[tuple[str, str | None, str]] = (),
) -> DataFrame:
    """Rows with ``f``, a struct (title, date, project, codes, version, doc_type) of a file name without its extension.

    First a leading date, copy noise and a trailing version come off the whole name;
    then the parts between separators are told apart: a first upper-case part is the
    project (the configured one, or one of at most five characters) or a code, parts of a
    code pattern are codes, a part that is a date is the date if there is none yet,
    and the others are the title (else the first code, else the whole name).  The note
    behind a version goes to the title.  ``keywords`` are (word, type) rules on whole
    words of the title, then ``codes_to_type`` (code prefix, text in the title or None,
    type) on the codes; the first that fits decides.
    """
    c, none, text = F.col, F.array().cast("array<string>"), F.lit(None).cast("string")
    is_code = lambda s: F.lit(False) if not code_patterns else s.rlike("|".join(f"^(?:{p})" for p in code_patterns))
    own = F.upper("_first") == F.lit((project_id or "").upper()) if project_id else F.lit(False)
    kind = F
    for word, doc_type in keywords:
        kind = kind.when(c("_title").rlike(rf"(?i)(^|[_-])\Q{word}\E($|[_-])"), doc_type)
    for prefix, inside, doc_type in codes_to_type:
        fits = F.exists("_codes", _starts(prefix))
        kind = kind.when(fits if inside is None else fits & F.lower("_title").contains(inside.lower()), doc_type)
    kind = text if kind is F else kind
    # Each step is a column of its own, so that none is worked out twice.
    steps = [
        ("_lead", F.regexp_extract(stem, DATE, 1)),
        ("_rest", F.regexp_replace(F.when(c("_lead") != "", F.regexp_extract(stem, DATE, 2)).otherwise(c(stem)), NOISE, "")),
        ("_version", F.regexp_extract("_rest", VERSION, 2)), ("_note", F.regexp_extract("_rest", VERSION, 4)),
        ("_body", F.when(c("_version") != "", F.regexp_replace(F.regexp_replace("_rest", VERSION, ""), "[_ ]+$", "")).otherwise(c("_rest"))),
        ("_parts", F.split("_body", separator)), ("_first", F.get("_parts", F.lit(0))),
        ("_upper", c("_first").rlike("[A-Z]") & (c("_first") == F.upper("_first"))), ("_own", c("_upper") & own), ("_taken", c("_own") | (c("_upper") & (F.length("_first") <= 5))),
        ("_head_code", c("_taken") & ~c("_own") & is_code(c("_first"))),
        ("_left", F.when(c("_taken"), F.slice("_parts", 2, F.greatest(F.size("_parts") - 1, F.lit(0)))).otherwise(c("_parts"))),
        ("_codes", F.concat(F.when(c("_head_code"), F.array("_first")).otherwise(none), F.filter("_left", is_code))),
        ("_inner", F.when(c("_lead") == "", F.get(F.filter("_left", lambda s: s.rlike(r"^\d{4}-\d{2}-\d{2}$") & ~is_code(s)), F.lit(0)))),
        ("_at", F.coalesce(F.array_position("_left", c("_inner")), F.lit(0))),
        ("_titled", F.filter("_left", lambda s, k: ~is_code(s) & (k + 1 != c("_at")))),
        ("_title", F.concat(F.when(F.size("_titled") > 0, F.array_join("_titled", separator)).when(F.size("_codes") > 0, F.get("_codes", F.lit(0))).otherwise(c(stem)), c("_note"))),
        ("_whole", F.length(stem) > LONGEST), ("_plain", c("_whole") | (c("_body") == "")),
    ]
    out = rows
    for name, column in steps:
        out = out.withColumn(name, column)
    found = F.struct(
        F.when(c("_plain"), c(stem)).otherwise(c("_title")).alias("title"), F.when(~c("_whole"), F.when(c("_lead") != "", c("_lead")).when(~c("_plain"), c("_inner"))).alias("date"),
        F.when(~c("_plain") & c("_taken") & ~c("_head_code"), c("_first")).alias("project"), F.when(c("_plain"), none).otherwise(c("_codes")).alias("codes"),
        F.when(~c("_whole") & (c("_version") != ""), F.concat(F.lit("v"), format_version(c("_version")))).alias("version"), F.when(~c("_plain"), kind).alias("doc_type"),
    )
    return out.withColumn("f", found).select(*rows.columns, "f")
