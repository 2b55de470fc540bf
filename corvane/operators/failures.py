"""Metrics of a failure log: heads of version chains, the merge that carried a commit, containment and rates.

Commits are a table (sha, parent, subject, stamp), ``parent`` being the first one; the default branch is a table
(sha, subject, stamp, date, inside), one row a merge, ``inside`` marking those of the asked window.  All
stored commits are mapped at once: no commit is walked alone, and no group of equal subjects is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import discard, materialize
from .components import dealt

#: What names a commit, and what names a ticket (fixed values).
COMMIT, TICKET = "^[0-9a-f]{7,40}$", r"\bT-[0-9]{4}\b"
#: Letters of a hash by which abbreviations meet it.
_PREFIX = 7
#: Seconds of a bucket of time, within which carriers are looked for before later buckets are.
_BUCKET = 86_400


def chain_heads(rows: DataFrame, edges: DataFrame, prefer_archived: bool = False) -> DataFrame:
    """One row per failure_id: rows, heads (rows that no edge supersedes), edge_head, proxy_head, head, disagrees, multiple.

    ``rows`` is (doc_id, failure_id, lifecycle_status), a row a version; ``edges`` (source_id, target_id), newer to
    older, of which only those between two of the rows count.  The definition is the edges'; the row that is
    not archived (with ``prefer_archived`` the one that is) stands beside it, and ``head`` is the proxy only with
    ``prefer_archived``.  Of several heads, or several rows of a status, the least doc_id counts.  ``head`` is
    null where the chosen rule finds none.  A null status is not archived.
    """
    known = rows.select("doc_id").distinct()
    inner = edges.join(known.withColumnRenamed("doc_id", "source_id"), "source_id", "left_semi")
    old = inner.select(F.col("target_id").alias("doc_id")).distinct().withColumn("old", F.lit(True))
    archived = F.coalesce(F.col("lifecycle_status") == "archived", F.lit(False))
    head, proxy = F.col("old").isNull(), archived if prefer_archived else ~archived
    found = rows.join(old, "doc_id", "left").groupBy("failure_id").agg(
        F.count("*").alias("rows"), F.count_if(head).alias("heads"), F.min(F.when(head, F.col("doc_id"))).alias("edge_head"), F.min(F.when(proxy, F.col("doc_id"))).alias("proxy_head"),
    )
    chosen = F.col("proxy_head" if prefer_archived else "edge_head")
    return found.select("*", chosen.alias("head"), (~F.col("edge_head").eqNullSafe(F.col("proxy_head"))).alias("disagrees"), (F.col("heads") > 1).alias("multiple"))


def failure_order(failure_id: Column) -> Column:
    """Sorts failure ids by the number at their end, those without one last; ``F2`` comes before ``F100``."""
    number = F.regexp_extract(failure_id, "([0-9]+)$", 1)
    return F.struct((number == "").cast("int").alias("unnumbered"), F.coalesce(number.try_cast("decimal(38,0)"), F.lit(0)).alias("number"), F.regexp_replace(failure_id, "[0-9]+$", "").alias("prefix"))


def next_at_or_after(asked: DataFrame, given: DataFrame, by: list[str]) -> DataFrame:
    """For every distinct (``by``, stamp) of ``asked`` the given (stamp, sha) of the key with the least stamp not before it; none: no row.

    A null stamp asks for the key's earliest; given rows without a stamp do not count.  A key is dealt by days: what a day itself does not answer, the first later
    day that has anything does, so the window over a key holds a row a day and not the key's rows.
    """
    day = F.floor(F.coalesce("stamp", F.lit(-(1 << 62))) / _BUCKET)
    own = asked.select(*by, "stamp").distinct().withColumn("day", day)
    have = given.where("stamp is not null").groupBy(*by, "stamp").agg(F.min("sha").alias("sha")).withColumn("day", day)
    none = F.lit(None).cast("string")
    both = own.select(*by, "day", "stamp", F.lit(True).alias("asks"), none.alias("sha")).unionByName(have.select(*by, "day", "stamp", F.lit(False).alias("asks"), "sha"))
    item = F.when(~F.col("asks"), F.struct("stamp", "sha"))
    # Equal stamps: the given row is among the peers, as a range frame takes them all.
    ahead = Window.partitionBy(*by, "day").orderBy(F.col("stamp").desc()).rangeBetween(Window.unboundedPreceding, 0)
    within = both.withColumn("hit", F.min(item).over(ahead)).where("asks").drop("sha", "asks")
    days = both.groupBy(*by, "day").agg(F.min(item).alias("first"))
    later = Window.partitionBy(*by).orderBy(F.col("day").desc()).rowsBetween(Window.unboundedPreceding, -1)
    after = days.select(*[F.col(c).alias(f"k_{c}") for c in by], F.col("day").alias("k_day"), F.min("first").over(later).alias("after"))
    joined = within.join(after, [F.col(c) == F.col(f"k_{c}") for c in by] + [F.col("day") == F.col("k_day")])
    hit = F.coalesce("hit", "after")
    return joined.where(hit.isNotNull()).select(*by, "stamp", hit["stamp"].alias("at"), hit["sha"].alias("carrier"))


def _tickets(subject: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(subject, F.lit("")), F.lit(f"({TICKET})"), 1))


def carriers(commits: DataFrame, merged: DataFrame) -> DataFrame:
    """(sha, carrier, tier): the oldest merge, not older than the commit, whose subject starts with the commit's, else one that names a ticket of it.

    Commits with neither have no row.  A merge's subject is cut at those lengths only that commits' subjects
    have, so prefixes meet as equal keys and only those that some commit has are kept.
    """
    named = commits.where("subject <> ''")
    lengths = named.agg(F.collect_set(F.length("subject")).alias("lengths"))  # one row, as many numbers as there are lengths of subjects
    cut = merged.where("subject is not null").join(F.broadcast(lengths)).withColumn("length", F.explode("lengths")).where(F.col("length") <= F.length("subject"))
    starts = cut.select(F.lit("subject_prefix").alias("tier"), F.expr("substring(subject, 1, length)").alias("text"), "stamp", "sha")
    starts = starts.join(named.select(F.col("subject").alias("text")).distinct(), "text", "left_semi").select("tier", "text", "stamp", "sha")
    tickets = lambda df: df.select(F.lit("ticket_id").alias("tier"), F.explode(_tickets(F.col("subject"))).alias("text"), "stamp", "sha")
    asked = named.select(F.lit("subject_prefix").alias("tier"), F.col("subject").alias("text"), "stamp", "sha").unionByName(tickets(named))
    found = next_at_or_after(asked, starts.unionByName(tickets(merged)), ["tier", "text"])
    match = [F.col(f"a.{c}").eqNullSafe(F.col(f"f.{c}")) for c in ("tier", "text", "stamp")]
    hits = asked.alias("a").join(found.alias("f"), match).select("a.sha", "a.tier", "f.at", "f.carrier")
    best = hits.groupBy("sha").agg(F.min(F.struct("tier", "at", "carrier")).alias("hit"))  # subject_prefix sorts before ticket_id
    return best.select("sha", "hit.carrier", "hit.tier")


def mapped_commits(stored: DataFrame, commits: DataFrame, merged: DataFrame) -> DataFrame:
    """(stored, merged_sha, reason) of every distinct stored commit field: the merge that carries it, and how that was found.

    Reasons: on_main, subject_prefix, ticket_id, first_parent (found for an ancestor), and unresolvable, prose (no hash)
    or null, without a merge.  A hash may be abbreviated to seven letters; an ambiguous one is unresolvable.  The way along
    first parents ends at the first commit with a carrier, or without result where it meets the default branch, a root or
    a cycle.  It is found for all commits off the branch by pointer doubling, log2 of the longest way in joins.
    """
    asked = stored.select("stored").distinct().withColumn("name", F.regexp_replace("stored", r"^\s+|\s+$", ""))
    hashes = asked.where(F.col("name").rlike(COMMIT))
    full = commits.select("sha").distinct().withColumn("prefix", F.substring("sha", 1, _PREFIX))
    meant = hashes.withColumn("prefix", F.substring("name", 1, _PREFIX)).join(full, "prefix").where(F.startswith("sha", "name"))
    known = meant.groupBy("stored").agg(F.min("sha").alias("sha"), F.count("*").alias("n")).where("n = 1").select("stored", "sha")

    main = merged.select("sha").distinct().withColumn("main", F.lit(True))
    marked = commits.dropDuplicates(["sha"]).join(main, "sha", "left")
    off = marked.where("main is null")
    own = carriers(off, merged)
    # ``next`` is null where the way ends: at a commit with a carrier, at a root, or before the branch.
    ends = marked.select(F.col("sha").alias("parent"), F.coalesce("main", F.lit(False)).alias("parent_main"), F.lit(True).alias("there"))
    steps = off.join(own, "sha", "left").join(ends, "parent", "left")
    goes = F.col("carrier").isNull() & F.coalesce("there", F.lit(False)) & ~F.coalesce("parent_main", F.lit(False))
    state = materialize(steps.select("sha", F.when(goes, F.col("parent")).alias("next"), "carrier", "tier"), "ways")
    most = max(state.count(), 1).bit_length() + 1
    for _ in range(most):  # what a cycle keeps going has no end, whatever the number of rounds
        if state.where("next is not null").limit(1).count() == 0:
            break
        last = state
        ahead = last.select(F.col("sha").alias("next"), F.col("next").alias("after"), F.col("carrier").alias("found"))
        state = materialize(last.join(dealt(ahead), "next", "left").select("sha", F.col("after").alias("next"), F.coalesce("carrier", "found").alias("carrier"), "tier"), "ways")
        discard(last)
    # A null tier with a carrier was found for an ancestor.
    way = state.select("sha", "carrier", F.when(F.col("carrier").isNotNull(), F.coalesce("tier", F.lit("first_parent"))).alias("tier"))
    rows = asked.join(known, "stored", "left").join(main, "sha", "left").join(way, "sha", "left")
    shape = F.when(F.col("stored").isNull(), "null").when(~F.col("name").rlike(COMMIT), "prose").when(F.col("main"), "on_main")
    return rows.select("stored", F.when(F.col("main"), F.col("sha")).otherwise(F.col("carrier")).alias("merged_sha"), F.coalesce(shape, "tier", F.lit("unresolvable")).alias("reason"))


def judged(heads: DataFrame, mapped: DataFrame, merged: DataFrame, gate_date: str, span_days: int = 28) -> DataFrame:
    """What each failure counts for: failure_id, failure_class, reason, merged_sha, introduced, observed, caught, post_gate, verdict, escaped_in_window, disagrees, active_with_fix.

    ``heads`` is (failure_id, failure_class, lifecycle_status, document_date, caught_by_gate, introduction_commit,
    fix_commit, reached_main, reached_main_present, is_baseline), a row a failure; baselines are measurements and join nothing.  The
    span opens ``span_days`` before the window's last merge, or at its first one if that is earlier.  A failure without the
    key ``reached_main`` is out_of_population; one without a named introduction escaped, as it was seen on the working
    system; one whose introduction or fix was not found is undetermined; else it is contained if one merge
    carried both.  ``disagrees``: the stored flag says otherwise.
    """
    inside = merged.where("inside")
    span = inside.agg(F.max("date").alias("tip"), F.least(F.date_sub(F.max("date"), span_days), F.min("date")).alias("opens"))  # a single row
    shas = inside.select(F.col("sha").alias("intro_sha")).distinct().withColumn("in_window", F.lit(True))
    side = lambda name: mapped.where("stored is not null").select(F.col("stored").alias(f"{name}_stored"), F.col("merged_sha").alias(f"{name}_sha"), F.col("reason").alias(f"{name}_reason"))
    # Missing commits meet nothing, and are dealt over all tasks.
    spread = lambda c: F.coalesce(c, F.concat(F.lit("\n"), F.xxhash64("failure_id").cast("string")))
    rows = heads.where(~F.coalesce("is_baseline", F.lit(False)))
    rows = rows.join(side("intro"), spread(F.col("introduction_commit")) == F.col("intro_stored"), "left").join(side("fix"), spread(F.col("fix_commit")) == F.col("fix_stored"), "left")
    rows = rows.join(shas, "intro_sha", "left").join(F.broadcast(span))
    reason, here = F.when(F.col("introduction_commit").isNull(), "null").otherwise(F.coalesce("intro_reason", F.lit("unresolvable"))), F.coalesce("in_window", F.lit(False))
    verdict = (
        F.when(~F.coalesce("reached_main_present", F.lit(False)), "out_of_population").when(reason.isin("null", "prose"), "escaped")
        .when(F.col("intro_sha").isNull() | F.col("fix_sha").isNull(), "undetermined").when(F.col("intro_sha") == F.col("fix_sha"), "contained").otherwise("escaped")
    )
    observed = F.coalesce(F.col("document_date").between(F.col("opens"), F.col("tip")), F.lit(False))
    held = verdict.isin("contained", "escaped") & F.col("reached_main").isNotNull() & (F.col("reached_main") != (verdict == "escaped"))
    return rows.select(
        "failure_id", "failure_class", reason.alias("reason"), F.col("intro_sha").alias("merged_sha"), here.alias("introduced"), observed.alias("observed"), (observed & F.coalesce("caught_by_gate", F.lit(False))).alias("caught"),
        (observed & (F.col("document_date") >= F.lit(gate_date).cast("date"))).alias("post_gate"), verdict.alias("verdict"), (here & (verdict == "escaped")).alias("escaped_in_window"), held.alias("disagrees"),
        ((F.coalesce("lifecycle_status", F.lit("")) == "active") & F.col("fix_commit").isNotNull()).alias("active_with_fix"),
        (F.coalesce("reached_main_present", F.lit(False)) & F.col("reached_main").isNull()).alias("reached_main_null"),
    )


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(part / whole, 9))


def failure_metrics(found: DataFrame, merged: DataFrame) -> DataFrame:
    """The counts and rates of one window, a single row; a rate over nothing is null.

    introduction_rate is failures introduced per merge, commit_rate the share of merges that introduced any,
    gate_catch_rate caught of observed, containment_rate contained of contained and escaped, escape_rate escapes that the
    window introduced per merge.
    """
    n = lambda when: F.count_if(when)
    is_ = lambda verdict: n(F.col("verdict") == verdict)
    counts = found.agg(
        n(F.col("introduced")).alias("introduced"), F.count_distinct(F.when(F.col("introduced"), F.col("merged_sha"))).alias("introducing_merges"),
        *[n(F.col("reason") == r).alias(f"{r}_introduction") for r in ("null", "prose", "unresolvable")],
        n(F.col("observed")).alias("observed"), n(F.col("caught")).alias("caught"), n(F.col("post_gate")).alias("post_gate"),
        *[is_(v).alias(v) for v in ("contained", "escaped", "undetermined", "out_of_population")],
        n(F.col("escaped_in_window")).alias("escaped_in_window"), n(F.col("disagrees")).alias("stored_disagreements"), n(F.col("active_with_fix")).alias("active_with_fix"), n(F.col("reached_main_null")).alias("reached_main_null"),
    )
    merges = merged.agg(F.count_if(F.col("inside")).alias("merges"))
    c = F.col
    return counts.join(F.broadcast(merges)).select(
        "*", _ratio(c("introduced"), c("merges")).alias("introduction_rate"), _ratio(c("introducing_merges"), c("merges")).alias("commit_rate"), _ratio(c("caught"), c("observed")).alias("gate_catch_rate"),
        _ratio(c("contained"), c("contained") + c("escaped")).alias("containment_rate"), _ratio(c("escaped_in_window"), c("merges")).alias("escape_rate"),
    )


def recurrence(found: DataFrame) -> DataFrame:
    """(failure_class, n, share) of the observed failures since the gate; shares of their whole number, no class: unclassified."""
    classes = found.where("post_gate").groupBy(F.coalesce("failure_class", F.lit("unclassified")).alias("failure_class")).agg(F.count("*").alias("n"))
    total = classes.agg(F.sum("n").alias("total"))  # a single row
    return classes.join(F.broadcast(total)).select("failure_class", "n", _ratio(F.col("n"), F.col("total")).alias("share"))
