"""Rows of files to sections, records and facts.

Readers take (path, text) rows, as ``spark.read.text(wholetext=True)`` or a table
gives them, and work on lines and values, so a long file spreads like any table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import source_type, stem_of
from ..functions.text import SEPARATOR, lexical_class
from ..plans.lineage import materialize


def markdown_sections(files: DataFrame) -> DataFrame:
    """Sections of Markdown files: path, title, section, level, heading_path, content.

    Headings are ``#`` lines and lines underlined by ``===`` or ``---``, outside fences
    of back-ticks or tildes.  Front matter between ``---`` lines at the start is left out.
    A heading without a text is no heading and its body stays above.  Text before the
    first heading is section 0, without a path.  The title is the first heading of
    level one, else the file's name.  Files without a text have no sections.
    """
    order = Window.partitionBy("path").orderBy("at")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    lines = files.where("text is not null").select("path", F.posexplode(F.split("text", "\r\n|\r|\n")).alias("at", "line"))
    # Front matter: from a first line of dashes to the next one; without a next one it is text.
    dashes = F.col("line").rlike(r"^---\s*$")
    ruled = lines.withColumn("opens", F.max(F.when((F.col("at") == 0) & dashes, 1)).over(Window.partitionBy("path"))).withColumn("close", F.min(F.when(dashes & (F.col("at") > 0), F.col("at"))).over(Window.partitionBy("path")))
    body = ruled.where("opens is null or close is null or at > close")
    fence = F.col("line").rlike(r"^ {0,3}(```|~~~)")
    fenced = body.withColumn("inside", (F.sum(fence.cast("int")).over(so_far) % 2 == 1) | fence)
    below, above = F.lead("line").over(order), F.lag("line").over(order)
    plain = ~F.col("inside")
    under = plain & F.col("line").rlike(r"^ {0,3}(=+|-{3,})\s*$") & F.coalesce(F.trim(above) != "", F.lit(False)) & ~F.coalesce(above.rlike(r"^ {0,3}#{1,6}(\s|$)"), F.lit(False)) & ~F.coalesce(F.lag("inside").over(order), F.lit(False))
    atx = F.regexp_extract("line", r"^ {0,3}(#{1,6})(\s|$)", 1)
    marked = fenced.select(
        "path", "at", "line", F.when(plain, F.length(atx)).otherwise(0).alias("atx"), under.alias("under"),
        (plain & F.coalesce(below.rlike(r"^ {0,3}(=+|-{3,})\s*$"), F.lit(False)) & (F.trim("line") != "") & (F.length(atx) == 0)).alias("over"), F.coalesce(below.rlike(r"^ {0,3}=+\s*$"), F.lit(False)).alias("first"),
    )
    text = F.when(F.col("atx") > 0, F.trim(F.regexp_replace(F.regexp_replace("line", r"^ {0,3}#{1,6}", ""), r"\s+#+\s*$", ""))).when(F.col("over"), F.trim("line"))
    level = F.when(F.col("atx") > 0, F.col("atx")).when(F.col("over"), F.when(F.col("first"), 1).otherwise(2))
    headed = marked.where("not under").withColumn("heading", F.when(F.coalesce(text, F.lit("")) != "", text)).withColumn("level", F.when(F.col("heading").isNotNull(), level))
    # Of every level the latest heading; it stands in a path unless a lower level came after it.
    latest = lambda k: F.last(F.when(F.col("level") == k, F.struct("at", "heading")), ignorenulls=True).over(so_far)
    numbered = headed.withColumn("section", F.count("heading").over(so_far)).withColumns({f"h{k}": latest(k) for k in range(1, 7)})
    path = []
    for k in range(1, 7):
        blocked = [F.coalesce(F.col(f"h{j}.at") > F.col(f"h{k}.at"), F.lit(False)) for j in range(1, k)]
        stands = F.col(f"h{k}").isNotNull()
        for b in blocked:
            stands = stands & ~b
        path.append(F.when(stands, F.col(f"h{k}.heading")))
    placed = numbered.withColumn("heading_path", F.array_join(F.array_compact(F.array(*path)), SEPARATOR))
    first = placed.where("level = 1").groupBy("path").agg(F.min_by("heading", "at").alias("title"))
    content = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("heading").isNull() & (F.col("atx") == 0), F.struct("at", "line")))), lambda x: x["line"]), "\n")
    sections = placed.groupBy("path", "section").agg(F.max("level").alias("level"), F.min_by("heading_path", "at").alias("heading_path"), F.trim(F.regexp_replace(content, r"^\s+|\s+$", "")).alias("content"))
    named = sections.join(first, "path", "left").withColumn("title", F.coalesce("title", stem_of(F.col("path"))))
    return named.where("section > 0 or content <> ''").select("path", "title", "section", "level", "heading_path", "content")


def passages_of(sections: DataFrame, most_bytes: int) -> DataFrame:
    """Passages of sections, each with its heading as a ``#`` line before it: path, section, piece, heading_path, content.

    A section whose heading and content fit ``most_bytes`` is one passage.  A longer one is
    cut at lines, except where the heading alone takes more than three quarters of the
    bound: such a section stays whole.
    """
    head = F.when(F.col("level").isNotNull(), F.concat(F.repeat(F.lit("#"), F.col("level").cast("int")), F.lit(" "), F.element_at(F.split("heading_path", SEPARATOR), -1), F.lit("\n\n"))).otherwise("")
    room = F.lit(most_bytes) - F.octet_length(head)
    whole = (F.octet_length("content") <= room) | (room < most_bytes / 4)
    units = F.split("content", "\n")
    packed = F.aggregate(
        units, F.array().cast("array<string>"),
        lambda acc, u: F.when((F.size(acc) > 0) & (F.octet_length(F.element_at(acc, -1)) + F.octet_length(u) + 1 <= room), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat_ws("\n", F.element_at(acc, -1), u)))).otherwise(F.concat(acc, F.array(u))),
    )
    pieces = F.when(whole, F.array("content")).otherwise(packed)
    return sections.select("path", "section", "heading_path", F.posexplode(F.transform(pieces, lambda p: F.concat(head, p))).alias("piece", "content")).select("path", "section", "piece", "heading_path", "content")


def json_records(files: DataFrame) -> DataFrame:
    """Top-level records of JSON and JSON-lines files as text: path, record, text.  A file named .jsonl has a record a line;
    in others an array's members are records, and anything else is one.  What is no JSON is left out.
    """
    # Only an array starts with a bracket, behind the spaces that JSON allows.
    listed = F.ltrim(F.col("text"), F.lit(" \t\n\r")).startswith("[") & F.try_parse_json(F.col("text")).isNotNull()
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    rows = F.when(F.lower("path").endswith(".jsonl"), lines).when(listed, F.from_json("text", "array<string>")).otherwise(F.array("text"))
    lines = files.where("text is not null").select("path", F.posexplode(rows).alias("record", "text"))
    return lines.where(F.try_parse_json(F.col("text")).isNotNull())


#: A row of a delimited file (quoted fields may hold line ends), and what separates rows (fixed values).
ROW, ROW_END = r'((?:[^"\r\n]++|"(?:[^"]++|"")*+")++)', r"\r\n|\r|\n"


def _delimiter() -> Column:
    return F.when(F.lower("path").endswith(".tsv"), F.lit("\t")).otherwise(F.lit(","))


def _fields(row: Column, delimiter: str) -> Column:
    """Fields of a row: quoted ones without their quotes, doubled quotes inside as one."""
    found = F.regexp_extract_all(row, F.lit(rf'(?:^|{delimiter})("(?:[^"]++|"")*+"|[^"{delimiter}]*+)'), 1)
    return F.transform(found, lambda f: F.when(f.startswith('"'), F.replace(F.substring(f, F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))).otherwise(f))


def delimited_rows(files: DataFrame) -> DataFrame:
    """Rows of delimited files (a .tsv by tabs, others by commas): path, row, fields, well_formed.

    A byte order mark and empty lines are passed over; a quoted field may hold delimiters,
    line ends and doubled quotes.  A row with a quote that nothing closes, or with text
    around a quoted field, is not well formed: it has no fields and is reported.
    """
    text = F.regexp_replace("text", "^\ufeff", "")
    # What is left between the rows that can be read is a row that cannot.
    parts = F.filter(F.regexp_extract_all(text, F.lit(rf'(?s){ROW}|("[^\r\n]*+)'), 0), lambda r: r != "")
    rows = files.where("text is not null").select("path", F.posexplode(parts).alias("row", "line"))
    fields = F.when(_delimiter() == "\t", _fields(F.col("line"), "\t")).otherwise(_fields(F.col("line"), ","))
    width = lambda f: F.length(F.array_join(F.transform(F.regexp_extract_all(F.col("line"), F.lit(rf'(?:^|{f})("(?:[^"]++|"")*+"|[^"{f}]*+)'), 0), lambda x: x), ""))
    whole = F.when(_delimiter() == "\t", width("\t")).otherwise(width(",")) == F.length("line")
    return rows.select("path", "row", F.when(whole, fields).alias("fields"), whole.alias("well_formed"))


def delimited_records(files: DataFrame) -> DataFrame:
    """Rows below the first as records like those of JSON files: path, record, text; the first well-formed row names the fields.

    A repeated name gets its place behind it, an empty or missing one is ``column_<place>``; fields
    that a row lacks are not in its record.  Rows that are not well formed are left out (see ``delimited_rows``).
    """
    rows = delimited_rows(files).where("well_formed")
    first = rows.groupBy("path").agg(F.min_by("fields", "row").alias("header"), F.min("row").alias("at"))
    plain = F.transform("header", lambda h, i: F.when(F.trim(h) == "", F.concat(F.lit("column_"), i + 1)).otherwise(h))
    named = first.withColumn("header", F.transform(plain, lambda h, i: F.when(F.array_position(plain, h) == i + 1, h).otherwise(F.concat(h, F.lit("_"), i + 1))))
    name = lambda i: F.coalesce(F.get("header", i), F.concat(F.lit("column_"), i + 1))
    record = F.map_from_entries(F.transform("fields", lambda f, i: F.struct(name(i), f)))
    return rows.join(named, "path").where("row > at").select("path", (F.col("row") - F.col("at") - 1).alias("record"), F.to_json(record).alias("text"))


def malformed_records(files: DataFrame) -> DataFrame:
    """What ``json_records`` leaves out: path, line (from 1; 0 for a whole file), text."""
    lines = files.where("text is not null and lower(path) like '%.jsonl'").select("path", F.posexplode(F.split("text", "\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)
    whole = files.where("text is not null and lower(path) not like '%.jsonl'").select("path", F.lit(0).alias("line"), "text")
    return lines.where(F.trim("text") != "").unionByName(whole).where(F.try_parse_json(F.col("text")).isNull())


def facts(records: DataFrame, depth: int = 64, most_nodes: int = 400_000) -> DataFrame:
    """Scalar facts of JSON records: path, record, field_path, value, kind, whatever their nesting.

    One level is opened a step, until no record has a deeper one; list members share their
    list's path with ``[]``, and a list or object without members has no facts.  A record
    nested deeper than ``depth`` or with more than ``most_nodes`` facts is refused: it has one
    row, of kind depth_reached or nodes_reached, and no facts.
    """
    kind = F.schema_of_variant(F.col("v"))

    def leveled(rows: DataFrame) -> DataFrame:
        """Written once with what is asked of it: scalars as strings, only nested values as variants."""
        some = rows.withColumn("nested", kind.startswith("OBJECT") | kind.startswith("ARRAY"))
        return materialize(some.select("path", "record", "large", "field_path", "nested", F.when(F.col("nested"), F.col("v")).alias("v"), F.when(~F.col("nested"), F.col("v").cast("string")).alias("value")), "facts")

    # n facts take 2n letters at least, so only a long record can have too many.
    large = F.octet_length("text") > 2 * most_nodes
    level = leveled(records.select("path", "record", large.alias("large"), F.lit("").alias("field_path"), F.parse_json(F.col("text")).alias("v")))
    done, deep = [level.where("not nested")], None
    while level.where("nested").limit(1).count():
        inside = level.where("nested").drop("value", "nested")
        if len(done) > depth:
            deep = inside.select("path", "record").distinct()
            break
        opened = inside.lateralJoin(inside.sparkSession.tvf.variant_explode(F.col("v").outer()).withColumnRenamed("value", "member"))
        step = F.when(F.col("key").isNull(), "[]").when(F.col("field_path") == "", F.col("key")).otherwise(F.concat(F.lit("."), F.col("key")))
        level = leveled(opened.select("path", "record", "large", F.concat("field_path", step).alias("field_path"), F.col("member").alias("v")))
        done.append(level.where("not nested"))
    found = reduce(DataFrame.unionByName, done)
    flat = found.select("path", "record", "field_path", "value", lexical_class(F.col("value")).alias("kind"))
    many = found.where("large").groupBy("path", "record").count().where(F.col("count") > most_nodes).select("path", "record", F.lit("nodes_reached").alias("why"))
    refused = many if deep is None else deep.withColumn("why", F.lit("depth_reached")).unionByName(many.join(deep, ["path", "record"], "left_anti"))
    refused = materialize(refused, "refused")
    none = F.lit(None).cast("string")
    return flat.join(refused.select("path", "record"), ["path", "record"], "left_anti").unionByName(refused.select("path", "record", F.lit("").alias("field_path"), none.alias("value"), F.col("why").alias("kind")))


def narrative_facts(files: DataFrame, most_bytes: int) -> DataFrame:
    """Paragraphs of prose (between blank lines) as facts: path, place, text; only those of at most ``most_bytes``."""
    rows = files.where("text is not null").select("path", F.posexplode(F.split("text", r"\n\s*\n")).alias("place", "text"))
    return rows.withColumn("text", F.trim(F.regexp_replace("text", r"^\s+|\s+$", ""))).where((F.col("text") != "") & (F.octet_length("text") <= most_bytes))


def scan(files: DataFrame, docs: DataFrame, root: str, depth: int = 16, most_files: int = 10_000) -> DataFrame:
    """Files (path, hash, bytes) of a folder against the vault: path, source_type, status, truncated.

    Hidden and lock files are passed over, as are those deeper than ``depth``.  Status in this
    order: no_adapter, unchanged (its hash is known), modified (its path, whole or
    below the root, is), new.  Beyond ``most_files`` in path order the scan is truncated.
    """
    below = F.regexp_replace("path", f"^{root}/", "")
    seen = files.where(~F.exists(F.split(below, "/"), lambda p: p.startswith(".") | p.startswith("~$")) & (F.size(F.split(below, "/")) <= depth)).withColumn("below", below)
    first = seen.orderBy("path").limit(most_files + 1).withColumn("k", F.row_number().over(Window.orderBy("path")))
    hashes = docs.where("source_content_hash is not null").select(F.col("source_content_hash").alias("hash")).distinct().withColumn("known", F.lit(True))
    paths = docs.where("source_path is not null").select(F.col("source_path").alias("p")).distinct().withColumn("held", F.lit(True))
    rows = first.join(hashes, "hash", "left").join(paths.withColumnRenamed("p", "path"), "path", "left").join(paths.select(F.col("p").alias("below"), F.col("held").alias("held_below")), "below", "left")
    kind = source_type(F.col("path"))
    status = F.when(kind.isNull(), "no_adapter").when(F.col("known"), "unchanged").when(F.col("held") | F.col("held_below"), "modified").otherwise("new")
    cut = F.max("k").over(Window.partitionBy()) > most_files
    return rows.withColumn("truncated", cut).where(F.col("k") <= most_files).select("path", kind.alias("source_type"), status.alias("status"), "truncated")


def surface(title: Column, tags: Column, path: Column, abstract: Column) -> Column:
    """(matchable, orienting) text of a document: what people wrote, and what was derived."""
    return F.struct(F.concat_ws(" ", title, F.array_join(tags, " "), stem_of(path)).alias("matchable"), F.coalesce(abstract, F.lit("")).alias("orienting"))
