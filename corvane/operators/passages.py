"""Passages, sections and document text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .filters import under_heading


def section_key():
    return F.coalesce("section_index", "chunk_index")


def sections(passages: DataFrame) -> DataFrame:
    """Consecutive passages of one section key, joined: document_id, section, first_chunk, heading_path, text."""
    order = Window.partitionBy("document_id").orderBy("chunk_index")
    changed = F.coalesce((section_key() != F.lag(section_key()).over(order)).cast("int"), F.lit(1))
    grouped = passages.where("chunk_index >= 0").withColumn("changed", changed).withColumn("section", F.sum("changed").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", "content"))), lambda c: c["content"]), "")
    return grouped.groupBy("document_id", "section").agg(F.min("chunk_index").alias("first_chunk"), F.min_by("heading_path", "chunk_index").alias("heading_path"), F.count("*").alias("passages"), text.alias("text"))


def document_text(passages: DataFrame, separator: str = "\n\n") -> DataFrame:
    """The document again: passages joined to sections, sections by a blank line."""
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("section", "text"))), lambda s: s["text"]), separator)
    return sections(passages).groupBy("document_id").agg(text.alias("text"), F.count("*").alias("sections"))


def headings(passages: DataFrame) -> DataFrame:
    """Heading paths of every document in order of appearance."""
    return passages.where("chunk_index >= 0").groupBy("document_id", "heading_path").agg(F.min("chunk_index").alias("first_chunk"), F.count("*").alias("passages"))


def read_section(passages: DataFrame, document_id: str, heading: str) -> DataFrame:
    """Sections under a heading of one document, in order."""
    return sections(passages.where((F.col("document_id") == document_id) & under_heading(heading)))


def split_lines(texts: DataFrame, most: int) -> DataFrame:
    """(document_id, piece, text): lines packed to pieces of at most ``most`` characters; their concatenation is the text.

    A longer line is cut at that many characters.  All inside the row, no shuffle.
    """
    units = F.flatten(F.transform(F.expr("regexp_extract_all(text, '([^\\n]*\\n|[^\\n]+$)', 1)"), lambda line: F.transform(F.sequence(F.lit(0), F.floor((F.length(line) - 1) / most).cast("int")), lambda k: F.substring(line, k * most + 1, F.lit(most)))))
    packed = F.aggregate(
        units, F.array().cast("array<string>"),
        lambda acc, u: F.when((F.size(acc) > 0) & (F.length(F.element_at(acc, -1)) + F.length(u) <= most), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(F.element_at(acc, -1), u)))).otherwise(F.concat(acc, F.array(u))),
    )
    return texts.select("document_id", F.posexplode(F.when(F.length("text") > 0, packed).otherwise(F.array().cast("array<string>"))).alias("piece", "text"))


def storage_counts(passages: DataFrame, small: int = 200) -> DataFrame:
    """Rows, documents, small fragments and bytes of a passage table."""
    return passages.agg(
        F.count("*").alias("rows"), F.countDistinct("document_id").alias("documents"), F.count_if(F.length("content") < small).alias("small_fragments"), F.sum(F.octet_length("content")).cast("long").alias("bytes")
    )
