"""Queries of files: Markdown, JSON, names and scans, made from the text tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names
from ..plans.oracle_tables import D, with_tables
from ..sources import files
from ..sources import graph_tables as g

CODES = (r"PV\d+", "REF")


def _markdown(spark, sf_dir):
    """Every conversation as a Markdown file: front matter, preamble, a heading per role and an underlined one with code per turn."""
    turns = g.table(spark, sf_dir, "conversations").where("text is not null")
    flat = F.trim(F.regexp_replace("text", r"\s+", " "))
    body = F.concat(F.lit("## "), "role", F.lit(" ##\n\n"), flat, F.lit("\nTurn "), F.col("turn").cast("string"), F.lit("\n---\n```\n# no heading\n```\n#\ntail"))
    rows = turns.select("conv_id", F.struct("turn", body.alias("b")).alias("t")).groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("t")), lambda x: x["b"]), "\n").alias("body"))
    text = F.concat(F.lit("---\ntitle: x\n---\nbefore\n"), F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("Conv "), F.col("conv_id").cast("string"), F.lit("\n===\n"))).otherwise(""), "body")
    return rows.select(F.concat(F.lit("v/c"), F.col("conv_id").cast("string"), F.lit(".md")).alias("path"), text.alias("text"))


def _json(spark, sf_dir):
    """Orders as JSON files of one record each."""
    orders = g.table(spark, sf_dir, "events")
    text = F.to_json(F.struct(F.col("event_type").alias("kind"), F.struct(F.col("user_id").alias("user"), F.array(F.col("event_type"), F.lit("x")).alias("tags")).alias("who"), F.lit(True).alias("ok")))
    return orders.select(F.concat(F.lit("e"), F.col("event_id").cast("string"), F.lit(".json")).alias("path"), text.alias("text"))


def _stem():
    n = F.col("n")
    return F.concat(
        F.when(n % 4 == 0, F.concat(F.coalesce("document_date", F.lit("2020-02-02")), F.lit("_"))).otherwise(""), F.when(n % 3 == 0, "ACME_").when(n % 3 == 1, "PV07_").otherwise("longproject_"),
        F.when(n % 5 == 0, F.concat(F.lit("PV"), (n % 9).cast("string"), F.lit("_"))).otherwise(""), F.when(n % 4 == 1, "2021-03-04_").otherwise(""), F.when(n % 6 != 0, F.concat("doc_type", F.lit("_Plan"), F.lit("_x"))).otherwise("REF"),
        F.when(n % 2 == 0, F.concat(F.lit("_v"), (n % 7).cast("string"), F.lit("_"), (n % 3).cast("string"), F.when(n % 10 == 0, "_FIXED").otherwise(""))).otherwise(""), F.when(n % 9 == 0, " copy 2").when(n % 9 == 1, "_(3)").otherwise(""),
    )


def q13_10_filenames(spark, sf_dir):
    rows = g.documents(spark, sf_dir).select("id", _stem().alias("stem"))
    found = names.parsed_names(rows, "stem", CODES, None, "_", [("plan", "plan")], [("PV", None, "paper"), ("REF", "ref", "reference")])
    return found.select("id", "stem", "f.title", "f.date", "f.project", F.array_join("f.codes", ",").alias("codes"), "f.version", "f.doc_type")


def q13_14_decision_numbers(spark, sf_dir):
    stem = F.when(F.col("doc_type") == "note", F.concat(F.lit("CAS-ADR-"), F.lpad((F.col("n") % 1000).cast("string"), 3, "0"), F.lit("_x"))).otherwise(F.col("title"))
    return g.documents(spark, sf_dir).select("id", names.decision_number(stem).alias("number"))


def q1_9_extensions(spark, sf_dir):
    endings = [e for some in names.EXTENSIONS.values() for e in some] + ["eml", ""]
    docs = g.documents(spark, sf_dir)
    path = F.concat("source_path", F.lit("."), F.element_at(F.array(*map(F.lit, endings)), (F.col("n") % len(endings) + 1).cast("int")))
    return docs.groupBy(names.source_type(path).alias("source_type")).agg(F.count("*").alias("files"))


def q1_1_markdown(spark, sf_dir):
    return files.markdown_sections(_markdown(spark, sf_dir)).select("path", "title", "section", "level", "heading_path", F.md5("content").alias("digest"))


def q11_2_chunking(spark, sf_dir):
    """The Markdown sections as passages of at most 120 bytes where a section has lines to cut it at, each with its heading."""
    pieces = files.passages_of(files.markdown_sections(_markdown(spark, sf_dir)), 120)
    return pieces.select("path", "section", "piece", F.octet_length("content").alias("bytes"), F.md5("content").alias("digest"))


def q1_6_json_records(spark, sf_dir):
    return files.json_records(_json(spark, sf_dir)).select("path", "record", F.get_json_object("text", "$.kind").alias("kind"))


def _delimited(spark, sf_dir):
    """The suppliers of each nation as a delimited file: a header, then a row each, with quotes, a line end and doubled quotes in a field."""
    rows = g.table(spark, sf_dir, "supplier")
    line = F.concat(F.lit('"'), "s_name", F.lit('",'), F.col("s_acctbal").cast("string"), F.lit(',"say ""'), "s_suppkey", F.lit('"",\nand more"'))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("s_suppkey", line.alias("line")))), lambda x: x["line"]), "\r\n")
    return rows.groupBy("s_nationkey").agg(body.alias("body")).select(F.concat(F.lit("n"), F.col("s_nationkey").cast("string"), F.lit(".csv")).alias("path"), F.concat(F.lit("name,,note\n"), "body").alias("text"))


def q1_6_delimited(spark, sf_dir):
    """Delimited files as records, and their facts."""
    found = files.facts(files.delimited_records(_delimited(spark, sf_dir)))
    return found.select("path", "record", "field_path", "value")


def q1_8_facts(spark, sf_dir):
    return files.facts(files.json_records(_json(spark, sf_dir)))


def q1_8_narrative(spark, sf_dir):
    docs = g.table(spark, sf_dir, "documents")
    rows = docs.select(F.col("doc_id").cast("string").alias("path"), F.regexp_replace("text", "\n", "\n\n").alias("text"))
    return files.narrative_facts(rows, 400).groupBy("path").agg(F.count("*").alias("facts"), F.sum(F.octet_length("text")).alias("bytes"))


def q1_11_scan(spark, sf_dir):
    docs = g.documents(spark, sf_dir)
    n, kind = F.col("n"), F.col("doc_type")
    path = F.when(kind == "memo", F.concat(F.lit("root/.hidden/"), "id", F.lit(".md"))).when(kind == "note", F.concat(F.lit("root/"), "source_path")).when(kind == "report", F.concat(F.lit("root/"), "id", F.lit(".eml"))).otherwise(F.concat(F.lit("root/new/"), "id", F.lit(".md")))
    rows = docs.select(path.alias("path"), F.when(F.col("metadata_confirmed"), F.col("source_content_hash")).otherwise(F.sha2("id", 256)).alias("hash"), F.octet_length("text").alias("bytes"))
    return files.scan(rows, docs, "root")


def q13_9_surfaces(spark, sf_dir):
    made = files.surface(F.col("title"), F.col("tags"), F.col("source_path"), F.col("semantic_abstract"))
    return g.documents(spark, sf_dir).select("id", made.alias("s")).select("id", "s.matchable", F.md5("s.orienting").alias("orienting"))


QUERIES = {n: f for n, f in list(globals().items()) if n.startswith("q") and callable(f)}

_TURNS = r"""c AS (SELECT conv_id, turn, role, trim(regexp_replace(text, '\s+', ' ', 'g')) AS flat, row_number() OVER (PARTITION BY conv_id ORDER BY turn, '## ' || role) AS k FROM conversations WHERE text IS NOT NULL),
x AS (SELECT *, 'v/c' || conv_id || '.md' AS path, conv_id % 2 = 0 AS top, CASE WHEN conv_id % 2 = 0 THEN 'Conv ' || conv_id || ' > ' ELSE '' END AS up, CASE WHEN conv_id % 2 = 0 THEN 1 ELSE 0 END AS o FROM c),
s AS (
  SELECT path, CASE WHEN top THEN 'Conv ' || conv_id ELSE 'c' || conv_id END AS title, 2 * k - 1 + o AS section, 2 AS level, up || role AS heading_path, flat AS content, top FROM x
  UNION ALL SELECT path, CASE WHEN top THEN 'Conv ' || conv_id ELSE 'c' || conv_id END, 2 * k + o, 2, up || 'Turn ' || turn, '```' || chr(10) || '# no heading' || chr(10) || '```' || chr(10) || 'tail', top FROM x
  UNION ALL SELECT DISTINCT path, CASE WHEN top THEN 'Conv ' || conv_id ELSE 'c' || conv_id END, 0, NULL, '', 'before', top FROM x
  UNION ALL SELECT DISTINCT path, 'Conv ' || conv_id, 1, 1, 'Conv ' || conv_id, '', top FROM x WHERE top)"""
_STEM = """b AS (
  SELECT id, n, doc_type, document_date, CASE WHEN n % 4 = 0 THEN coalesce(document_date, '2020-02-02') END AS lead, CASE n % 3 WHEN 0 THEN 'ACME' WHEN 1 THEN 'PV07' ELSE 'longproject' END AS head,
    CASE WHEN n % 5 = 0 THEN 'PV' || n % 9 END AS code, CASE WHEN n % 4 = 1 THEN '2021-03-04' END AS inner_date, n % 6 = 0 AS ref, CASE WHEN n % 2 = 0 THEN 'v' || n % 7 || '_' || n % 3 END AS ver,
    CASE WHEN n % 10 = 0 THEN '_FIXED' ELSE '' END AS note, CASE n % 9 WHEN 0 THEN ' copy 2' WHEN 1 THEN '_(3)' ELSE '' END AS noise FROM d),
t AS (
  SELECT *, concat_ws('_', lead, head, code, inner_date, CASE WHEN ref THEN 'REF' ELSE doc_type || '_Plan_x' END) || coalesce('_' || ver || note, '') || noise AS stem,
    concat_ws(',', CASE WHEN head = 'PV07' THEN 'PV07' END, code, CASE WHEN ref THEN 'REF' END) AS codes,
    CASE WHEN head = 'longproject' THEN CASE WHEN ref THEN 'longproject' ELSE 'longproject_' || doc_type || '_Plan_x' END WHEN NOT ref THEN doc_type || '_Plan_x' WHEN head = 'PV07' THEN 'PV07' WHEN code IS NOT NULL THEN code ELSE 'REF' END
      || CASE WHEN ver IS NULL THEN '' ELSE note END AS title FROM b)"""

ORACLE = {
    "q13_10_filenames": with_tables(f"""{_STEM} SELECT id, stem, title, coalesce(lead, inner_date) AS date, CASE WHEN head = 'ACME' THEN 'ACME' END AS project, codes, 'v' || n % 7 || '.' || n % 3 || CASE WHEN n % 2 = 0 THEN '' END AS version,
      CASE WHEN NOT ref THEN 'plan' WHEN head = 'PV07' OR code IS NOT NULL THEN 'paper' WHEN lower(title) LIKE '%ref%' THEN 'reference' END AS doc_type FROM t""", D),
    "q13_14_decision_numbers": with_tables("SELECT id, CASE WHEN doc_type = 'note' THEN lpad(CAST(n % 1000 AS VARCHAR), 3, '0') END AS number FROM d", D),
    "q1_9_extensions": with_tables("""x AS (SELECT (n % 19) AS k FROM d)
      SELECT CASE WHEN k < 2 THEN 'markdown' WHEN k = 2 THEN 'text' WHEN k < 5 THEN 'json' WHEN k < 7 THEN 'yaml' WHEN k = 7 THEN 'toml' WHEN k = 8 THEN 'xml' WHEN k < 11 THEN 'delimited' WHEN k < 13 THEN 'docx' WHEN k = 13 THEN 'pdf'
        WHEN k < 16 THEN 'pptx' WHEN k = 16 THEN 'xlsx' END AS source_type, count(*) AS files FROM x GROUP BY 1""", D),
    "q1_1_markdown": f"WITH {_TURNS} SELECT path, title, section, level, heading_path, md5(content) AS digest FROM s",
    "q11_2_chunking": f"""WITH {_TURNS}, y AS (SELECT path, section, CASE level WHEN 1 THEN '# ' || heading_path || chr(10) || chr(10) WHEN 2 THEN '## ' || string_split(heading_path, ' > ')[-1] || chr(10) || chr(10) ELSE '' END || content AS t FROM s)
      SELECT path, section, 0 AS piece, CAST(strlen(t) AS INTEGER) AS bytes, md5(t) AS digest FROM y""",
    "q1_6_json_records": "SELECT 'e' || event_id || '.json' AS path, 0 AS record, event_type AS kind FROM events",
    "q1_6_delimited": """WITH r AS (SELECT *, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS INTEGER) AS record FROM supplier)
      SELECT 'n' || s_nationkey || '.csv' AS path, record, unnest(['name', 'column_2', 'note']) AS field_path, unnest([s_name, CAST(s_acctbal AS VARCHAR), 'say "' || s_suppkey || '",' || chr(10) || 'and more']) AS value FROM r""",
    "q1_8_facts": """WITH f AS (SELECT 'e' || event_id || '.json' AS path, unnest(['kind', 'ok', 'who.user', 'who.tags[]', 'who.tags[]']) AS field_path, unnest([event_type, 'true', CAST(user_id AS VARCHAR), event_type, 'x']) AS value,
        unnest(['text', 'boolean', 'number', 'text', 'text']) AS kind FROM events) SELECT path, 0 AS record, field_path, value, kind FROM f""",
    "q1_8_narrative": r"""WITH p AS (SELECT CAST(doc_id AS VARCHAR) AS path, unnest(string_split(text, chr(10))) AS x FROM documents), q AS (SELECT path, regexp_replace(x, '^\s+|\s+$', '', 'g') AS x FROM p)
      SELECT path, count(*) AS facts, CAST(sum(strlen(x)) AS BIGINT) AS bytes FROM q WHERE x <> '' AND strlen(x) <= 400 GROUP BY 1""",
    "q1_11_scan": with_tables("""x AS (SELECT *, CASE doc_type WHEN 'note' THEN 'root/' || source_path WHEN 'report' THEN 'root/' || id || '.eml' ELSE 'root/new/' || id || '.md' END AS path FROM d WHERE doc_type <> 'memo' AND NOT (doc_type = 'note' AND source_path LIKE '%/./%')),
      y AS (SELECT *, row_number() OVER (ORDER BY path) AS k, count(*) OVER () AS c FROM x)
      SELECT path, CASE WHEN doc_type <> 'report' THEN 'markdown' END AS source_type, CASE WHEN doc_type = 'report' THEN 'no_adapter' WHEN metadata_confirmed THEN 'unchanged' WHEN doc_type = 'note' THEN 'modified' ELSE 'new' END AS status, c > 10000 AS truncated FROM y WHERE k <= 10000""", D),
    "q13_9_surfaces": with_tables("SELECT id, title || ' ' || array_to_string(tags, ' ') || ' ' || regexp_extract(source_path, '([^/]*)[.]md$', 1) AS matchable, md5(coalesce(semantic_abstract, '')) AS orienting FROM d", D),
}
