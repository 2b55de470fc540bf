"""Queries of maintenance, intake and the checks of abstracts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import audits, names
from ..operators import maintenance
from ..plans.oracle_tables import D, E, P, with_tables
from ..sources import graph_tables as g


def q17_3_edge_plan(spark, sf_dir):
    """Every edge as a plan of its source's project: references again, supersessions turned around, the inferred ones to be removed."""
    docs, edges = g.documents(spark, sf_dir), g.edges(spark, sf_dir).where("target_id is not null")
    path = lambda c: F.concat(F.lit("f/"), c)
    turned = F.col("edge_type") == "supersedes"
    plan = edges.join(docs.select(F.col("id").alias("source_id"), F.col("doc_type").alias("t"), F.col("project").alias("p")), "source_id").select(
        F.concat("p", F.lit("/"), "t", F.lit("/"), F.when(turned, "s").otherwise("r")).alias("repair_group"), F.when((F.col("rationale") != "manual") & ~turned, "remove").otherwise("add").alias("action"),
        path(F.when(turned, F.col("target_id")).otherwise(F.col("source_id"))).alias("source_path"), path(F.when(turned, F.col("source_id")).otherwise(F.col("target_id"))).alias("target_path"), "edge_type",
        F.when(F.col("edge_type") == "depends_on", 2).otherwise(1).alias("tier"),
    )
    ids = docs.where("pipeline_status <> 'failed'").select(path(F.col("id")).alias("path"), "id")
    found = maintenance.executed_plan(plan, ids, docs, edges)
    return found.groupBy("repair_group", "action", "edge_type", "outcome").agg(F.count("*").alias("rows"))


def _with_headers(spark, sf_dir):
    docs, passages = g.documents(spark, sf_dir), g.passages(spark, sf_dir).select("document_id", "chunk_index", "content")
    heads = docs.where("doc_type in ('note', 'memo')").select(F.col("id").alias("document_id"), F.lit(-1).alias("chunk_index"), F.col("title").alias("content"))
    return docs, passages.unionByName(heads), docs.where("doc_type in ('memo', 'report')").select(F.col("id").alias("document_id"), F.lit("own").alias("matchable"))


def q17_17_surfaces(spark, sf_dir):
    _, passages, surfaces = _with_headers(spark, sf_dir)
    left, made = maintenance.surfaces_from_headers(passages, surfaces)
    return made.join(left.groupBy("document_id").agg(F.count("*").alias("passages")), "document_id", "left")


def q17_18_structure(spark, sf_dir):
    rows = g.passages(spark, sf_dir).withColumn("structure", F.when(F.col("chunk_index") % 2 == 0, "kept"))
    return maintenance.with_structure(rows, F.regexp_extract("heading_path", " > (.*)$", 1)).groupBy("structure").agg(F.count("*").alias("passages"))


def q17_19_divided(spark, sf_dir):
    return maintenance.divided(g.passages(spark, sf_dir), 300).groupBy("document_id", "chunk_index").agg(F.sum(F.length("content")).alias("characters"), (F.max(F.length("content")) <= 300).alias("bounded"), (F.count("*") > 1).alias("cut"))


def q17_21_empty_projections(spark, sf_dir):
    docs, passages = g.documents(spark, sf_dir), g.passages(spark, sf_dir)
    return maintenance.empty_projections(docs, passages.where(F.length("content") > 400))


def q17_10_migration(spark, sf_dir):
    docs, passages, surfaces = _with_headers(spark, sf_dir)
    return maintenance.migration_report({
        "headers": passages.where("chunk_index = -1"), "long": passages.where(F.length("content") > 300), "empty": maintenance.empty_projections(docs, passages), "nothing": surfaces.where("false"),
    })


def q11_5_recovery(spark, sf_dir):
    docs = g.documents(spark, sf_dir).withColumn("pipeline_status", F.when(F.col("doc_type") == "note", "indexing").when(F.col("doc_type") != "memo", F.col("pipeline_status")))
    made = docs.select(F.col("id").alias("document_id"), F.when(F.col("metadata_confirmed"), F.col("source_content_hash")).otherwise("old").alias("hash"))
    return maintenance.recovery(docs, made)


def q11_6_sweep(spark, sf_dir):
    docs = g.documents(spark, sf_dir).withColumn("source_path", F.when(F.col("doc_type") == "note", F.concat("source_path", F.lit(".PDF"))).otherwise(F.col("source_path")))
    return maintenance.sweep(docs).groupBy("outcome").agg(F.count("*").alias("documents"))


def _intake(spark, sf_dir):
    docs = g.documents(spark, sf_dir)
    path = F.when(F.col("doc_type") == "note", F.concat(F.lit("in/"), "id", F.lit(".eml"))).when(F.col("doc_type") == "memo", F.col("source_path")).otherwise(F.concat(F.lit("in/"), "id", F.lit(".md")))
    rows = docs.select(path.alias("path"), F.when(F.col("metadata_confirmed"), F.col("source_content_hash")).when(F.col("project") == "proj1", F.sha2(F.lit("same"), 256)).otherwise(F.sha2("id", 256)).alias("hash"))
    return maintenance.intake(rows, docs.groupBy("source_path").agg(F.max("id").alias("id"), F.max("source_content_hash").alias("source_content_hash")), names.source_type(F.col("path")))


def q11_1_intake(spark, sf_dir):
    return _intake(spark, sf_dir)


def q11_7_intake_summary(spark, sf_dir):
    return _intake(spark, sf_dir).groupBy("verdict").agg(F.count("*").alias("files"))


def q10_9_coverage(spark, sf_dir):
    """How much of a document's characters its passages hold, and its longer ones represent."""
    docs, passages = g.documents(spark, sf_dir), g.passages(spark, sf_dir)
    held = passages.groupBy(F.col("document_id").alias("id")).agg(F.sum(F.length("content")).alias("observed"), F.sum(F.when(F.length("content") > 60, F.length("content")).otherwise(0)).alias("represented"))
    total = F.length(F.replace("text", F.lit("\n"), F.lit("")))
    rows = docs.select("id", F.when(F.col("doc_type") != "memo", total).alias("total")).join(held, "id", "left")
    return rows.select("id", maintenance.coverage(F.coalesce("observed", F.lit(0)), F.coalesce("represented", F.lit(0)), F.col("total")).alias("c")).select("id", "c.scope", "c.ratio")


def q18_11_gold_set(spark, sf_dir):
    docs = g.documents(spark, sf_dir)
    entries = docs.select(F.when(F.col("doc_type") != "memo", F.col("title")).alias("query"), F.when(F.col("project") != "proj2", F.col("id")).alias("primary"), F.array("id", F.lit("d00000001")).alias("related"))
    judged, errors = maintenance.graded(entries)
    return judged.unionByName(errors.select("query", F.col("primary").alias("document_id"), F.lit(0).alias("grade")))


def q17_14_evidence(spark, sf_dir):
    """Lines of every document as facts by section and length, within 500 bytes."""
    rows = g.passages(spark, sf_dir).select("document_id", F.col("section_index").cast("string").alias("region"), F.when(F.length("content") > 80, "long").otherwise("short").alias("field"), F.col("content").alias("text"), "chunk_index")
    turned = rows.withColumn("turn", F.row_number().over(Window.partitionBy("document_id", "region", "field").orderBy("chunk_index")))
    found = maintenance.evidence(turned, 500)
    return found.groupBy("document_id").agg(F.count("*").alias("facts"), F.max("cost").alias("bytes"), F.max("slot").alias("slot"))


def q7_9_headings(spark, sf_dir):
    """Headings that fit the title of the first French documents, best tier first."""
    paths = g.passages(spark, sf_dir).select("heading_path").distinct()
    ranked = paths.withColumn("tier", audits.heading_tier(F.col("heading_path"), "S1")).where("tier is not null")
    return ranked.orderBy("tier", F.length("heading_path"), "heading_path").limit(10)


def q13_16_sentences(spark, sf_dir):
    n = F.col("n")
    text = F.concat(F.lit("First of "), "title", F.lit(". "), F.when(n % 4 == 0, "See e.g. the").when(n % 4 == 1, "Is it (so?) and").when(n % 4 == 2, "items\n6. open").otherwise("no end"))
    return g.documents(spark, sf_dir).select("id", audits.trimmed_to_sentence(text).alias("text"))


def q13_17_acronyms(spark, sf_dir):
    n = F.col("n")
    abstract = F.concat(F.lit("The AB (alpha beta) and gamma delta (GD) of "), "doc_type", F.lit(" with XY (not this)."))
    source = F.when(n % 3 == 0, "the Alpha-Betas say").when(n % 3 == 1, "a gamma  delta, here").otherwise(F.lit(None))
    rows = g.documents(spark, sf_dir).select("id", abstract.alias("abstract"), audits.acronym_glosses(abstract, source).alias("found"))
    return rows.select("id", F.array_join(F.transform("found", lambda x: F.concat(x["acronym"], F.lit("="), x["expansion"])), ";").alias("found"), audits.without_glosses(F.col("abstract"), F.col("found")).alias("repaired"))


def q13_19_cardinals(spark, sf_dir):
    n = F.col("n")
    source = F.concat_ws("\n", F.transform(F.sequence(F.lit(1), (n % 3 + 1).cast("int")), lambda k: F.concat(F.lit("## Turn "), k.cast("string"))), F.when(n % 5 == 0, "nine things"))
    abstract = F.concat(F.lit("There are "), F.when(n % 4 == 0, "about three").when(n % 4 == 1, "three").when(n % 4 == 2, "9").otherwise("twenty-one"), F.lit(" turns."))
    found = audits.turn_claims(abstract, F.when(n % 7 != 0, source).otherwise("turn by turn"))
    return g.documents(spark, sf_dir).select("id", F.explode(found).alias("f")).select("id", "f.surface", "f.value", "f.derived", "f.attested")


def q13_20_openers(spark, sf_dir):
    n = F.col("n")
    text = F.concat(F.lit("This "), F.when(n % 2 == 0, "document").otherwise("idea"), F.lit(" is "), F.when(n % 3 == 0, "about ").otherwise("a short "), "doc_type", F.lit("-12, and more. Next."))
    found = audits.type_opener(text, F.col("doc_type"))
    return g.documents(spark, sf_dir).select("id", found.alias("f")).select("id", "f.verb", "f.surface")


def q13_20_repairs(spark, sf_dir):
    """First lines of the documents behind openers of several shapes, and what is left of them."""
    n, said = F.col("n"), F.regexp_replace("semantic_abstract", "[.!?]", ",")
    opener = F.concat(F.lit("This document "), F.when(n % 3 == 0, "serves as").otherwise("is"), F.lit(" a short "), "doc_type", F.when(n % 4 == 1, " (its-12)").when(n % 4 == 2, " of weight").otherwise(""))
    text = F.concat(F.lit(" "), opener, F.when(n % 5 == 0, ", which ").when(n % 5 == 1, " which ").otherwise(" that "), F.lit("lists "), said, F.lit(". It is e.g. this. "))
    rows = g.documents(spark, sf_dir).where("semantic_abstract is not null").select("id", "doc_type", text.alias("text"))
    return rows.select("id", F.md5(audits.without_type_opener(F.col("text"), F.col("doc_type"))).alias("digest"))


def q13_21_recorded(spark, sf_dir):
    """Every turn of the conversations with a closing remark against the turn before it."""
    t, c = F.col("turn"), F.col("conv_id")
    end = F.when((c + t) % 4 == 0, " See AB-12 to CD-3.").when((c + t) % 4 == 1, " It has two sampled rows, item0012 to end.").when((c + t) % 4 == 2, " ab-12, column: 7 and Item0012 through item0019.").otherwise("")
    said = F.concat(F.coalesce("text", F.lit("")), end)
    before = F.lag("said").over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    rows = g.table(spark, sf_dir, "conversations").withColumn("said", said).withColumn("before", before)
    return rows.select("conv_id", "turn", F.array_join(audits.recorded_findings(F.col("said"), F.col("before")), ",").alias("findings"))


def q13_21_findings(spark, sf_dir):
    n = F.col("n")
    text, evidence = F.concat(F.lit("see AB-12 and CD_7"), F.when(n % 3 == 0, " or EF-9").otherwise("")), F.when(n % 2 == 0, "AB-12, CD_7 stand").otherwise("CD_7")
    structure = F.when(n % 5 == 0, F.array(F.lit("list"))).otherwise(F.array().cast("array<string>"))
    return g.documents(spark, sf_dir).select("id", F.array_join(audits.unsupported_identifiers(text, evidence), ",").alias("identifiers"), F.array_join(audits.publication_findings(text, evidence, structure), ",").alias("findings"))


QUERIES = {n: f for n, f in list(globals().items()) if n.startswith("q") and callable(f)}

_INTAKE = """o AS (SELECT source_path, max(id) AS id, max(source_content_hash) AS source_content_hash FROM d GROUP BY 1),
f AS (SELECT CASE doc_type WHEN 'note' THEN 'in/' || id || '.eml' WHEN 'memo' THEN source_path ELSE 'in/' || id || '.md' END AS path, doc_type,
  CASE WHEN metadata_confirmed THEN source_content_hash WHEN project = 'proj1' THEN sha256('same') ELSE sha256(id) END AS hash FROM d),
i AS (SELECT path, CASE WHEN doc_type = 'note' THEN 'unsupported' WHEN hash IN (SELECT source_content_hash FROM o) THEN 'duplicate' WHEN row_number() OVER (PARTITION BY hash ORDER BY path) > 1 THEN 'duplicate_in_batch'
  WHEN path IN (SELECT source_path FROM o) THEN 'would_supersede' ELSE 'would_create' END AS verdict, hash FROM f)"""

ORACLE = {
    "q17_3_edge_plan": with_tables("""b AS (SELECT e.*, edge_type = 'supersedes' AS turned, s.doc_type AS t, s.project AS p FROM e JOIN d s ON s.id = e.source_id WHERE target_id IS NOT NULL),
      q AS (SELECT p || '/' || t || '/' || CASE WHEN turned THEN 's' ELSE 'r' END AS repair_group, CASE WHEN rationale <> 'manual' AND NOT turned THEN 'remove' ELSE 'add' END AS action, edge_type,
        CASE WHEN turned THEN target_id ELSE source_id END AS s, CASE WHEN turned THEN source_id ELSE target_id END AS t, CASE WHEN edge_type = 'depends_on' THEN 2 ELSE 1 END AS tier FROM b),
      j AS (SELECT q.*, a.id IS NOT NULL AND z.id IS NOT NULL AS known, EXISTS (SELECT 1 FROM e WHERE e.source_id = q.s AND e.target_id = q.t AND e.edge_type = q.edge_type) AS there, w.lifecycle_status AS state
        FROM q LEFT JOIN (SELECT id FROM d WHERE pipeline_status <> 'failed') a ON a.id = q.s LEFT JOIN (SELECT id FROM d WHERE pipeline_status <> 'failed') z ON z.id = q.t LEFT JOIN d w ON w.id = q.t),
      r AS (SELECT *, CASE WHEN action = 'add' THEN CASE WHEN NOT known THEN 'ingestion_failed' WHEN edge_type = 'supersedes' AND NOT there AND coalesce(state, '') <> 'active' THEN 'illegal_transition' END END AS refused FROM j),
      h AS (SELECT *, bool_or(refused IS NOT NULL) OVER (PARTITION BY repair_group) AS held FROM r)
      SELECT repair_group, action, edge_type, CASE WHEN action = 'add' THEN coalesce(refused, CASE WHEN there THEN 'landed' WHEN tier = 2 THEN 'staged' ELSE 'created' END) WHEN held THEN 'withheld' WHEN there AND known THEN 'removed' ELSE 'absent' END AS outcome, count(*) AS rows
      FROM h GROUP BY ALL""", D, E),
    "q17_17_surfaces": with_tables("""SELECT id AS document_id, CASE WHEN doc_type = 'note' THEN title ELSE 'own' END AS matchable, (SELECT nullif(count(*), 0) FROM p WHERE p.document_id = d.id) AS passages FROM d WHERE doc_type IN ('note', 'memo', 'report')""", D, P),
    "q17_18_structure": with_tables("SELECT CASE WHEN chunk_index % 2 = 0 THEN 'kept' ELSE string_split(heading_path, ' > ')[2] END AS structure, count(*) AS passages FROM p GROUP BY 1", P),
    "q17_19_divided": with_tables("SELECT document_id, chunk_index, length(content) AS characters, TRUE AS bounded, length(content) > 300 AS cut FROM p", P),
    "q17_21_empty_projections": with_tables("SELECT id FROM d WHERE pipeline_status = 'abstraction_skipped' AND id NOT IN (SELECT document_id FROM p WHERE length(content) > 400)", D, P),
    "q17_10_migration": with_tables("""SELECT * FROM (SELECT 'headers' AS step, count(*) AS changed FROM d WHERE doc_type IN ('note', 'memo') UNION ALL SELECT 'long', count(*) FROM p WHERE length(content) > 300
      UNION ALL SELECT 'empty', count(*) FROM d WHERE pipeline_status = 'abstraction_skipped' AND doc_type NOT IN ('note', 'memo') AND id NOT IN (SELECT document_id FROM p)) WHERE changed > 0""", D, P),
    "q11_5_recovery": with_tables("SELECT id, CASE WHEN metadata_confirmed THEN 'abstract_only' ELSE 're_index' END AS action FROM d WHERE doc_type IN ('note', 'memo')", D),
    "q11_6_sweep": with_tables("""SELECT CASE WHEN doc_type = 'note' THEN 'skipped_kind' WHEN lifecycle_status = 'archived' THEN 'skipped_state' WHEN trim(text) = '' THEN 'skipped_empty' ELSE 'reabstract' END AS outcome, count(*) AS documents
      FROM d WHERE pipeline_status = 'abstraction_skipped' GROUP BY 1""", D),
    "q11_1_intake": with_tables(f"{_INTAKE} SELECT path, verdict, CASE verdict WHEN 'duplicate' THEN (SELECT min(id) FROM o WHERE source_content_hash = hash) WHEN 'would_supersede' THEN (SELECT max(id) FROM o WHERE source_path = path) END AS document_id FROM i", D),
    "q11_7_intake_summary": with_tables(f"{_INTAKE} SELECT verdict, count(*) AS files FROM i GROUP BY 1", D),
    "q10_9_coverage": with_tables("""h AS (SELECT document_id AS id, sum(length(content)) AS o, sum(CASE WHEN length(content) > 60 THEN length(content) ELSE 0 END) AS r FROM p GROUP BY 1),
      x AS (SELECT d.id, CASE WHEN doc_type <> 'memo' THEN length(replace(text, chr(10), '')) END AS t, coalesce(r, 0) AS r FROM d LEFT JOIN h USING (id))
      SELECT id, CASE WHEN t IS NULL THEN 'unknown' WHEN r = t THEN 'complete' ELSE 'limited' END AS scope, CASE WHEN t > 0 THEN round(r / t, 6) END AS ratio FROM x""", D, P),
    "q18_11_gold_set": with_tables("""v AS (SELECT CASE WHEN doc_type <> 'memo' THEN title END AS query, CASE WHEN project <> 'proj2' THEN id END AS prim, id FROM d),
      j AS (SELECT query, prim AS document_id, 2 AS grade FROM v WHERE query IS NOT NULL AND prim IS NOT NULL UNION ALL SELECT query, unnest([id, 'd00000001']), 1 FROM v WHERE query IS NOT NULL AND prim IS NOT NULL)
      SELECT query, document_id, max(grade) AS grade FROM j GROUP BY 1, 2 UNION ALL SELECT query, prim, 0 FROM v WHERE query IS NULL OR prim IS NULL""", D),
    "q17_14_evidence": with_tables("""f AS (SELECT document_id, CAST(section_index AS VARCHAR) AS region, CASE WHEN length(content) > 80 THEN 'long' ELSE 'short' END AS field, content, chunk_index FROM p),
      t AS (SELECT *, row_number() OVER (PARTITION BY document_id, region, field ORDER BY chunk_index) AS turn FROM f),
      s AS (SELECT document_id, row_number() OVER w AS slot, sum(strlen(content)) OVER (w ROWS UNBOUNDED PRECEDING) AS cost FROM t WINDOW w AS (PARTITION BY document_id ORDER BY turn, region, field, content))
      SELECT document_id, count(*) AS facts, CAST(max(cost) AS BIGINT) AS bytes, max(slot) AS slot FROM s WHERE cost <= 500 GROUP BY 1""", P),
    "q7_9_headings": with_tables("""h AS (SELECT DISTINCT heading_path, lower(string_split(heading_path, ' > ')[1]) AS a, lower(string_split(heading_path, ' > ')[2]) AS b FROM p),
      t AS (SELECT heading_path, CASE WHEN b = 's1' THEN 0 WHEN starts_with(b, 's1') THEN 1 WHEN contains(b, 's1') THEN 2 WHEN contains(a, 's1') THEN 3 END AS tier FROM h)
      SELECT heading_path, tier FROM t WHERE tier IS NOT NULL ORDER BY tier, length(heading_path), heading_path LIMIT 10""", P),
    "q13_16_sentences": with_tables("SELECT id, 'First of ' || title || '.' || CASE WHEN n % 4 = 1 THEN ' Is it (so?)' ELSE '' END AS text FROM d", D),
    "q13_17_acronyms": with_tables("""SELECT id, CASE n % 3 WHEN 0 THEN 'GD=gamma delta' WHEN 1 THEN 'AB=alpha beta' ELSE 'AB=alpha beta;GD=gamma delta' END AS found,
      'The AB' || CASE WHEN n % 3 = 0 THEN ' (alpha beta)' ELSE '' END || ' and ' || CASE WHEN n % 3 = 1 THEN 'gamma delta (GD)' ELSE 'GD' END || ' of ' || doc_type || ' with XY (not this).' AS repaired FROM d""", D),
    "q13_19_cardinals": with_tables("""x AS (SELECT id, n, CAST(n % 3 + 1 AS INTEGER) AS c, CASE n % 4 WHEN 1 THEN 3 WHEN 2 THEN 9 WHEN 3 THEN 21 END AS v, CASE n % 4 WHEN 1 THEN 'three' WHEN 2 THEN '9' WHEN 3 THEN 'twenty-one' END AS w FROM d WHERE n % 7 <> 0),
      y AS (SELECT *, v <= c OR v = 9 AND n % 5 = 0 AS said FROM x WHERE v IS NOT NULL) SELECT id, w || ' turns' AS surface, v AS value, c AS derived, said AS attested FROM y WHERE v <> c OR NOT said""", D),
    "q13_20_openers": with_tables("SELECT id, CASE WHEN n % 2 = 0 AND n % 3 <> 0 THEN 'is' END AS verb, CASE WHEN n % 2 = 0 AND n % 3 <> 0 THEN doc_type || '-12' END AS surface FROM d", D),
    "q13_20_repairs": with_tables("""x AS (SELECT id, n, doc_type, 'lists ' || regexp_replace(semantic_abstract, '[.!?]', ',', 'g') || '. It is e.g. this. ' AS tail,
        'a short ' || doc_type || CASE n % 4 WHEN 1 THEN ' (its-12)' WHEN 2 THEN ' of weight' ELSE '' END || CASE n % 5 WHEN 0 THEN ', which ' WHEN 1 THEN ' which ' ELSE ' that ' END AS class FROM d WHERE semantic_abstract IS NOT NULL)
      SELECT id, md5(' This document ' || CASE WHEN n % 4 <> 2 AND (n % 5 <> 0 OR n % 4 <> 1) THEN '' ELSE CASE WHEN n % 3 = 0 THEN 'serves as ' ELSE 'is ' END || class END || tail) AS digest FROM x""", D),
    "q13_21_recorded": r"""WITH s AS (SELECT *, coalesce(text, '') || CASE (conv_id + turn) % 4 WHEN 0 THEN ' See AB-12 to CD-3.' WHEN 1 THEN ' It has two sampled rows, item0012 to end.' WHEN 2 THEN ' ab-12, column: 7 and Item0012 through item0019.' ELSE '' END AS said FROM conversations),
      b AS (SELECT *, coalesce(lag(said) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST), '') AS before FROM s),
      i AS (SELECT *, regexp_extract_all(said, '(?i)\b(?:item\d{4,12}|[A-Z]{1,10}-\d{2,12})\b') AS own, regexp_extract_all(before, '(?i)\b(?:item\d{4,12}|[A-Z]{1,10}-\d{2,12})\b') AS old,
        regexp_extract_all(said, '(?i)\bitem\d{4,12}\s+(?:through|to)\s+([A-Za-z][A-Za-z0-9_-]*)\b') AS spans FROM b)
      SELECT conv_id, turn, concat_ws(',', CASE WHEN len(list_filter(own, lambda x: NOT list_contains(old, x))) > 0 THEN 'unsupported_identifier' END,
        CASE WHEN regexp_matches(said, '(?i)\b(?:\d+|one|two|three|four|five|six|seven|eight|nine|ten)\s+(?:(?:sampled|inspected)\s+)?(?:records?|rows?|columns?|fields?|departments?|sentences?)\b|\b(?:column|field)\s*:?\s*\d+\b') THEN 'bounded_structure' END,
        CASE WHEN len(list_filter(spans, lambda x: NOT contains(before, x) AND NOT regexp_matches(x, '(?i)\s(?:item\d{4,12}|[A-Z]{1,10}-\d{2,12})$'))) > 0 THEN 'range_role' END) AS findings FROM i""",
    "q13_21_findings": with_tables("""x AS (SELECT id, n, concat_ws(',', CASE WHEN n % 2 <> 0 THEN 'AB-12' END, CASE WHEN n % 3 = 0 THEN 'EF-9' END) AS i FROM d)
      SELECT id, i AS identifiers, concat_ws(',', CASE WHEN i <> '' THEN 'unsupported_identifier' END, CASE WHEN n % 5 = 0 THEN 'bounded_structure' END) AS findings FROM x""", D),
}
