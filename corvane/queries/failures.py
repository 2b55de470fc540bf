"""Queries of a failure log: events as versions of failures, documents as commits whose subjects are cut from their first lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import failures
from ..plans.lineage import materialize
from ..plans.oracle_tables import D, with_tables
from ..sources import graph_tables as g

GATE = "2024-01-03"


def _sha(n):
    return F.substring(F.sha2(F.concat(F.lit("c"), n.cast("string")), 256), 1, 40)


def _commits(spark, sf_dir):
    """(commits, merged): every sixteenth document is a merge, which keeps the subject, often the ticket, of one of the fifteen before it."""
    n = F.col("n")
    docs = g.documents(spark, sf_dir).select("n", F.col("semantic_abstract").alias("line"))
    ticket = F.concat(F.lit("T-"), F.lpad(F.floor(n / 32).cast("string"), 4, "0"))
    part = F.expr("substring(line, 1, int(3 + n % 30))")
    own = docs.select("n", F.when(n % 7 == 3, F.concat(ticket, F.lit(" "), part)).otherwise(part).alias("own"))
    turn = F.floor(n / 16)
    carried = own.select((n).alias("from"), F.col("own").alias("kept"))
    last = F.concat(F.lit("T-"), F.lpad(F.floor((n - 1) / 32).cast("string"), 4, "0"))
    suffix = F.concat(F.lit(" (#"), turn.cast("string"), F.lit(")"), F.when(turn % 3 != 1, F.concat(F.lit(" "), last)).otherwise(""))
    joined = own.join(carried, (n % 16 == 0) & (F.col("from") == n - 1 - turn % 5), "left")
    main = n % 16 == 0
    commits = joined.select(
        "n", _sha(n).alias("sha"), F.when(~main, _sha(n - 1)).when(n >= 16, _sha(n - 16)).alias("parent"),
        F.when(~main, F.col("own")).when(n == 0, "root").otherwise(F.concat(F.coalesce("kept", F.lit("")), suffix)).alias("subject"), (n * 3600 + n * 7919 % F.when(main, 50_000).otherwise(200_000)).alias("stamp"),
    )
    commits = materialize(commits, "commits")  # read many times, and the texts once
    total = docs.agg(F.count("*").alias("total"))
    dated = F.date_add(F.lit("2024-01-01").cast("date"), F.floor(n / 400).cast("int"))
    merged = commits.where(main).join(F.broadcast(total)).select("sha", "subject", "stamp", dated.alias("date"), (n * 2 >= F.col("total")).alias("inside"))
    return commits.drop("n"), merged


def _rows(spark, sf_dir):
    """(rows, edges): three events are the versions of a failure; some supersessions are missing."""
    events = g.table(spark, sf_dir, "events").join(F.broadcast(g.table(spark, sf_dir, "documents").agg(F.count("*").alias("total"))))
    f, t = F.col("event_id"), F.col("total")
    doc = lambda k: F.concat(F.lit("v"), F.lpad(k.cast("string"), 9, "0"))
    intro = (F.col("user_id") * 31 + f) % t
    rows = events.select(
        doc(f).alias("doc_id"), F.concat(F.lit("F"), F.floor(f / 3).cast("string")).alias("failure_id"), F.when((f % 3 == 2) | (f % 11 == 0), "active").otherwise("archived").alias("lifecycle_status"),
        F.col("ts").cast("date").alias("document_date"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("failure_class"), (F.col("value") > 20).alias("caught_by_gate"),
        F.when(f % 13 == 1, F.concat(F.lit("("), "event_type", F.lit(")"))).when(f % 13 != 0, F.substring(_sha(intro), F.lit(1), (7 + f % 34).cast("int"))).alias("introduction_commit"),
        F.when(f % 5 != 0, F.substring(_sha((intro + f % 20) % t), 1, 12)).alias("fix_commit"), F.when((f % 9 != 4) & ~(f % 9).isin(1, 2), F.col("value") > 50).alias("reached_main"), (f % 9 != 4).alias("reached_main_present"), (f % 17 == 0).alias("is_baseline"),
    )
    edges = events.where((f % 3 != 0) & (f % 10 != 9)).select(doc(f).alias("source_id"), doc(f - 1).alias("target_id"))
    return rows, edges


def _stored(rows):
    return rows.select(F.explode(F.array("introduction_commit", "fix_commit")).alias("stored"))


def _judged(spark, sf_dir):
    commits, merged = _commits(spark, sf_dir)
    rows, edges = _rows(spark, sf_dir)
    heads = failures.chain_heads(rows, edges).where("head is not null").select(F.col("head").alias("doc_id"))
    kept = materialize(rows.join(heads, "doc_id", "left_semi"), "heads")
    return failures.judged(kept, failures.mapped_commits(_stored(kept), commits, merged), merged, GATE), merged


def q17_15_log_heads(spark, sf_dir):
    return failures.chain_heads(*_rows(spark, sf_dir))


def q17_15_commit_mapping(spark, sf_dir):
    """Every stored commit field of every version, mapped to the merge that carries it."""
    commits, merged = _commits(spark, sf_dir)
    return failures.mapped_commits(_stored(_rows(spark, sf_dir)[0]), commits, merged)


def q17_15_judgements(spark, sf_dir):
    return _judged(spark, sf_dir)[0]


def q17_15_metrics(spark, sf_dir):
    return failures.failure_metrics(*_judged(spark, sf_dir))


def q17_15_recurrence(spark, sf_dir):
    return failures.recurrence(_judged(spark, sf_dir)[0])


QUERIES = {k: v for k, v in list(globals().items()) if k.startswith("q") and callable(v)}

_GIT = """own AS (SELECT n, CASE WHEN n % 7 = 3 THEN 'T-' || lpad(CAST(n // 32 AS VARCHAR), 4, '0') || ' ' ELSE '' END || substr(semantic_abstract, 1, 3 + n % 30) AS own FROM d),
  cm AS (SELECT o.n, substr(sha256('c' || o.n), 1, 40) AS sha, o.n % 16 = 0 AS main,
      CASE WHEN o.n % 16 <> 0 THEN substr(sha256('c' || (o.n - 1)), 1, 40) WHEN o.n >= 16 THEN substr(sha256('c' || (o.n - 16)), 1, 40) END AS parent,
      CASE WHEN o.n % 16 <> 0 THEN o.own WHEN o.n = 0 THEN 'root'
        ELSE coalesce(k.own, '') || ' (#' || o.n // 16 || ')' || CASE WHEN o.n // 16 % 3 <> 1 THEN ' T-' || lpad(CAST((o.n - 1) // 32 AS VARCHAR), 4, '0') ELSE '' END END AS subject,
      o.n * 3600 + o.n * 7919 % CASE WHEN o.n % 16 = 0 THEN 50000 ELSE 200000 END AS stamp
    FROM own o LEFT JOIN own k ON o.n % 16 = 0 AND k.n = o.n - 1 - o.n // 16 % 5),
  mg AS (SELECT sha, subject, stamp, CAST(DATE '2024-01-01' + CAST(n // 400 AS INTEGER) AS DATE) AS date, n * 2 >= (SELECT count(*) FROM documents) AS inside FROM cm WHERE main),
  t0 AS (SELECT sha, stamp, unnest(regexp_extract_all(subject, '\\bT-[0-9]{4}\\b')) AS ticket FROM cm),
  hits AS (SELECT c.sha, 'subject_prefix' AS tier, m.stamp, m.sha AS carrier FROM cm c JOIN mg m ON c.subject <> '' AND starts_with(m.subject, c.subject) AND m.stamp >= c.stamp WHERE NOT c.main
    UNION ALL SELECT a.sha, 'ticket_id', b.stamp, b.sha FROM t0 a JOIN cm c ON c.sha = a.sha AND NOT c.main JOIN t0 b ON a.ticket = b.ticket AND b.stamp >= a.stamp JOIN mg ON mg.sha = b.sha),
  hit AS (SELECT DISTINCT ON (sha) sha, tier, carrier FROM hits ORDER BY sha, tier, stamp, carrier),
  walk AS (SELECT sha AS start, sha AS cur, 0 AS depth FROM cm
    UNION ALL SELECT w.start, c.parent, w.depth + 1 FROM walk w JOIN cm c ON c.sha = w.cur LEFT JOIN hit h ON h.sha = w.cur WHERE NOT c.main AND h.sha IS NULL AND c.parent IS NOT NULL),
  ends AS (SELECT DISTINCT ON (start) start, cur, depth FROM walk ORDER BY start, depth DESC),
  way AS (SELECT e.start AS sha, CASE WHEN c.main AND depth = 0 THEN c.sha WHEN NOT c.main THEN h.carrier END AS merged_sha,
      CASE WHEN c.main AND depth = 0 THEN 'on_main' WHEN c.main OR h.carrier IS NULL THEN 'unresolvable' WHEN depth = 0 THEN h.tier ELSE 'first_parent' END AS reason
    FROM ends e LEFT JOIN cm c ON c.sha = e.cur LEFT JOIN hit h ON h.sha = e.cur)"""
_LOG = """ev AS (SELECT *, event_id AS f, (SELECT count(*) FROM documents) AS t FROM events),
  rw AS (SELECT f, 'v' || lpad(CAST(f AS VARCHAR), 9, '0') AS doc_id, 'F' || f // 3 AS failure_id, CASE WHEN f % 3 = 2 OR f % 11 = 0 THEN 'active' ELSE 'archived' END AS lifecycle_status,
      CAST(ts AS DATE) AS document_date, CASE WHEN event_type <> 'error' THEN event_type END AS failure_class, value > 20 AS caught_by_gate,
      CASE WHEN f % 13 = 1 THEN '(' || event_type || ')' WHEN f % 13 <> 0 THEN substr(sha256('c' || (user_id * 31 + f) % t), 1, 7 + f % 34) END AS introduction_commit,
      CASE WHEN f % 5 <> 0 THEN substr(sha256('c' || ((user_id * 31 + f) % t + f % 20) % t), 1, 12) END AS fix_commit,
      CASE WHEN f % 9 NOT IN (1, 2, 4) THEN value > 50 END AS reached_main, f % 9 <> 4 AS reached_main_present, f % 17 = 0 AS is_baseline FROM ev),
  su AS (SELECT DISTINCT f - 1 AS f FROM rw WHERE f % 3 <> 0 AND f % 10 <> 9),
  hd AS (SELECT failure_id, count(*) AS rows, count(*) FILTER (su.f IS NULL) AS heads, min(doc_id) FILTER (su.f IS NULL) AS edge_head, min(doc_id) FILTER (lifecycle_status <> 'archived') AS proxy_head
    FROM rw LEFT JOIN su USING (f) GROUP BY 1)"""


def _mapping(stored: str) -> str:
    return f"""st AS (SELECT DISTINCT unnest([introduction_commit, fix_commit]) AS stored FROM {stored}),
  nm AS (SELECT stored, min(sha) AS sha FROM st JOIN cm ON length(stored) >= 7 AND substr(sha, 1, 7) = substr(stored, 1, 7) AND starts_with(sha, stored) GROUP BY 1 HAVING count(*) = 1),
  mp AS (SELECT stored, merged_sha, CASE WHEN stored IS NULL THEN 'null' WHEN NOT regexp_full_match(stored, '[0-9a-f]{{7,40}}') THEN 'prose' ELSE coalesce(reason, 'unresolvable') END AS reason
    FROM st LEFT JOIN nm USING (stored) LEFT JOIN way USING (sha))"""


_JUDGED = f"""{_GIT}, {_LOG}, kept AS (SELECT rw.* FROM rw JOIN hd ON hd.edge_head = rw.doc_id), {_mapping("kept")},
  sp AS (SELECT max(date) AS tip, least(max(date) - 28, min(date)) AS opens FROM mg WHERE inside),
  j0 AS (SELECT k.*, i.reason, i.merged_sha, x.merged_sha AS fix_sha, i.merged_sha IN (SELECT sha FROM mg WHERE inside) AND i.merged_sha IS NOT NULL AS introduced, k.document_date BETWEEN opens AND tip AS observed,
      CASE WHEN NOT reached_main_present THEN 'out_of_population' WHEN i.reason IN ('null', 'prose') THEN 'escaped' WHEN i.merged_sha IS NULL OR x.merged_sha IS NULL THEN 'undetermined' WHEN i.merged_sha = x.merged_sha THEN 'contained' ELSE 'escaped' END AS verdict
    FROM kept k LEFT JOIN mp i ON i.stored IS NOT DISTINCT FROM k.introduction_commit LEFT JOIN mp x ON x.stored = k.fix_commit, sp WHERE NOT is_baseline),
  j AS (SELECT failure_id, failure_class, reason, merged_sha, coalesce(introduced, false) AS introduced, observed, observed AND caught_by_gate AS caught, observed AND document_date >= DATE '{GATE}' AS post_gate, verdict,
      coalesce(introduced, false) AND verdict = 'escaped' AS escaped_in_window, verdict IN ('contained', 'escaped') AND reached_main IS NOT NULL AND reached_main <> (verdict = 'escaped') AS disagrees,
      lifecycle_status = 'active' AND fix_commit IS NOT NULL AS active_with_fix, reached_main_present AND reached_main IS NULL AS reached_main_null FROM j0)"""

ORACLE = {
    "q17_15_log_heads": f"WITH {_LOG} SELECT *, edge_head AS head, edge_head IS DISTINCT FROM proxy_head AS disagrees, heads > 1 AS multiple FROM hd",
    "q17_15_commit_mapping": with_tables(f"{_GIT}, {_LOG}, {_mapping('rw')} SELECT * FROM mp", D),
    "q17_15_judgements": with_tables(f"{_JUDGED} SELECT * FROM j", D),
    "q17_15_metrics": with_tables(f"""{_JUDGED}, c AS (SELECT count(*) FILTER (introduced) AS introduced, count(DISTINCT merged_sha) FILTER (introduced) AS introducing_merges,
      count(*) FILTER (reason = 'null') AS null_introduction, count(*) FILTER (reason = 'prose') AS prose_introduction, count(*) FILTER (reason = 'unresolvable') AS unresolvable_introduction,
      count(*) FILTER (observed) AS observed, count(*) FILTER (caught) AS caught, count(*) FILTER (post_gate) AS post_gate, count(*) FILTER (verdict = 'contained') AS contained, count(*) FILTER (verdict = 'escaped') AS escaped,
      count(*) FILTER (verdict = 'undetermined') AS undetermined, count(*) FILTER (verdict = 'out_of_population') AS out_of_population, count(*) FILTER (escaped_in_window) AS escaped_in_window,
      count(*) FILTER (disagrees) AS stored_disagreements, count(*) FILTER (active_with_fix) AS active_with_fix, count(*) FILTER (reached_main_null) AS reached_main_null, (SELECT count(*) FROM mg WHERE inside) AS merges FROM j)
      SELECT *, CASE WHEN merges > 0 THEN round(introduced / merges, 9) END AS introduction_rate, CASE WHEN merges > 0 THEN round(introducing_merges / merges, 9) END AS commit_rate, CASE WHEN observed > 0 THEN round(caught / observed, 9) END AS gate_catch_rate,
      CASE WHEN contained + escaped > 0 THEN round(contained / (contained + escaped), 9) END AS containment_rate, CASE WHEN merges > 0 THEN round(escaped_in_window / merges, 9) END AS escape_rate FROM c""", D),
    "q17_15_recurrence": with_tables(f"{_JUDGED} SELECT coalesce(failure_class, 'unclassified') AS failure_class, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM j WHERE post_gate GROUP BY 1", D),
}
