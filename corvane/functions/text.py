"""Text functions as columns: identifier folding, structure, names, versions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = " > "


def fold_for_query(text: Column) -> Column:
    """Hyphens and underscores to spaces; alphabetic words of several capitalised parts split into them."""
    spaced = F.regexp_replace(text, "[-_]", " ")
    words = F.split(spaced, " ")
    return F.array_join(F.flatten(F.transform(words, compound_parts)), " ")


def compound_parts(word: Column) -> Column:
    """Parts of a camel-case word, or the word alone: letters only, two parts at least that make it up again."""
    parts = F.regexp_extract_all(word, F.lit("([A-Z]+(?![a-z])|[A-Z]?[a-z]+)"), 1)
    split = word.rlike("^[A-Za-z]+$") & word.rlike("[a-z][A-Z]|[A-Z]{2}[a-z]") & (F.size(parts) >= 2) & (F.array_join(parts, "") == word)
    return F.when(split, parts).otherwise(F.array(word))


def expand_for_index(text: Column) -> Column:
    """The text's words, then its folded words, each once, in order of first appearance."""
    return F.array_join(F.filter(F.array_distinct(F.concat(F.split(text, " "), F.split(fold_for_query(text), " "))), lambda w: w != ""), " ")


def indexed_structure(heading_path: Column, title: Column) -> Column:
    """The heading path without a first part that equals the title."""
    parts = F.split(heading_path, SEPARATOR)
    same = F.coalesce(F.trim(F.element_at(parts, 1)) == F.trim(title), F.lit(False))
    return F.when(same, F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), SEPARATOR)).otherwise(heading_path)


def embedding_input(heading_path: Column, content: Column) -> Column:
    return F.when(F.coalesce(heading_path, F.lit("")) == "", content).otherwise(F.concat(heading_path, F.lit("\n\n"), content))


def neutral_markup(text: Column) -> Column:
    return F.translate(text, "<>", "  ")


def slug(title: Column) -> Column:
    """Lower case, anything else than letters and digits to single underscores; empty is ``untitled``.

    Accents of Latin letters are dropped by a fixed translation.
    """
    plain = F.translate(F.lower(title), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    short = F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(short == "", "untitled").otherwise(short)


def document_id(source_path: Column, created_at: Column, title: Column) -> Column:
    return F.concat(F.substring(F.sha2(F.concat(source_path, created_at), 256), 1, 8), F.lit("_"), slug(title))


def well_formed_id(ident: Column) -> Column:
    return ident.rlike("^[0-9a-f]{8}_[a-z0-9_]+$")


def version_parts(version: Column) -> Column:
    """(major, minor, patch) as numbers; missing ones are 0."""
    numbers = F.regexp_extract_all(F.coalesce(version, F.lit("")), F.lit(r"(\d+)"), 1)
    at = lambda k: F.coalesce(F.get(numbers, F.lit(k)).try_cast("int"), F.lit(0))
    return F.struct(at(0).alias("major"), at(1).alias("minor"), at(2).alias("patch"))


def format_version(version: Column) -> Column:
    """major.minor, and the patch if the text has three numbers."""
    v, n = version_parts(version), F.size(F.regexp_extract_all(F.coalesce(version, F.lit("")), F.lit(r"(\d+)"), 1))
    return F.concat_ws(".", v["major"].cast("string"), v["minor"].cast("string"), F.when(n >= 3, v["patch"].cast("string")))


def rationale_kind(rationale: Column) -> Column:
    """Kind of an edge by the prefix of its rationale; manual by default."""
    return F.when(rationale.startswith("inferred:"), "inferred").when(rationale.startswith("imported:"), "imported").when(rationale.startswith("merged:"), "merged").otherwise("manual")


def token_budget(words: Column, base: int = 200, rate: float = 0.15, cap: int = 1000) -> Column:
    return F.least((F.lit(base) + words * rate).cast("int"), F.lit(cap))


def readable_cids(text: Column) -> Column:
    """``(cid:NN)`` of printable ASCII to its character; others stay."""
    parts = F.regexp_extract_all(text, F.lit(r"(\(cid:\d+\)|(?s:.))"), 1)
    code = lambda p: F.regexp_extract(p, r"^\(cid:(\d{1,3})\)$", 1)
    return F.array_join(F.transform(parts, lambda p: F.when(code(p).try_cast("int").between(32, 126), F.chr(code(p).try_cast("int"))).otherwise(p)), "")


def structure_echo(text: Column) -> Column:
    """Findings (line, kind) of headings, and of the first line of runs of two list lines or more."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    kind = F.transform(lines, lambda x: F.when(x.rlike(r"^\s*#{1,6}\s"), "heading").when(x.rlike(r"^\s*([-*+]|\d+[.)])\s"), "list").when(x.rlike(r"^\s*\*\*[^*]+\*\*:?\s*$"), "subhead").otherwise("prose"))
    at = lambda k: F.get(kind, k)
    index = F.sequence(F.lit(0), F.size(lines) - 1)
    first = lambda k: (at(k) == "heading") | (at(k).isin("list", "subhead") & (at(k + 1) == at(k)) & ~F.coalesce(at(k - 1) == at(k), F.lit(False)))
    return F.when(F.size(lines) > 0, F.transform(F.filter(index, lambda k: F.coalesce(first(k), F.lit(False))), lambda k: F.struct((k + 1).alias("line"), at(k).alias("kind"))))


def lexical_class(value: Column) -> Column:
    """null, boolean, number, date, identifier or text."""
    text = F.trim(value)
    return (
        F.when(text.isNull() | (text == ""), "null").when(F.lower(text).isin("true", "false"), "boolean").when(text.rlike(r"^[+-]?\d+(\.\d+)?([eE][+-]?\d+)?$"), "number")
        .when(text.rlike(r"^\d{4}-\d{2}-\d{2}") & F.try_to_timestamp(F.substring(text, 1, 10), F.lit("yyyy-MM-dd")).isNotNull(), "date")
        .when(text.rlike(r"^[A-Za-z0-9][A-Za-z0-9._:/-]*$") & text.rlike(r"\d"), "identifier").otherwise("text")
    )


def parse_date(text: Column) -> Column:
    """Timestamp of ISO text, naive as UTC; NULL for anything else."""
    return F.try_to_timestamp(text)


def even_picks(items: Column, most: int) -> Column:
    """``most`` items, evenly spaced, the first and last among them; all if there are fewer."""
    n = F.size(items)
    return F.when(n <= most, items).otherwise(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: F.get(items, (k * (n - 1) / (most - 1)).cast("int"))))
