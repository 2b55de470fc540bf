"""The failure log's operators against plain versions that walk one commit at a time."""

import random
import re

from conftest import DATA

from corvane.operators import failures
from corvane.queries import failures as queries

COMMITS, MERGED = "sha string, parent string, subject string, stamp long", "sha string, subject string, stamp long, date date, inside boolean"


def plain_mapping(stored, commits, merged):
    if stored is None:
        return None, "null"
    name = stored.strip()
    if not re.fullmatch("[0-9a-f]{7,40}", name):
        return None, "prose"
    meant = [c for c in commits if c.startswith(name)]
    if len(meant) != 1:
        return None, "unresolvable"
    at, seen = meant[0], set()
    while at in commits and at not in seen:
        if at in merged:
            return (at, "on_main") if not seen else (None, "unresolvable")
        parent, subject, stamp = commits[at]
        tickets = set(re.findall(failures.TICKET, subject or ""))
        tiers = (("subject_prefix", lambda s: s.startswith(subject)), ("ticket_id", lambda s: tickets & set(re.findall(failures.TICKET, s))))
        for tier, fits in tiers if subject else ():
            found = [(t, sha) for sha, (s, t) in merged.items() if s is not None and fits(s) and (stamp is None or t >= stamp)]
            if found:
                return min(found)[1], "first_parent" if seen else tier
        seen.add(at)
        at = parent
    return None, "unresolvable"


def test_mapping_of_random_histories(spark):
    for seed in range(3):
        r = random.Random(seed)
        sha = lambda k: f"{r.getrandbits(20):05x}{k:035x}"
        names = [sha(k) for k in range(160)]
        names[5] = names[4][:9] + "f" * 31  # an abbreviation that is ambiguous
        words = ["fix", "fix the", "fix the index", "T-0001 add", "add T-0002", "T-0003", "", None, "own"]
        commits, merged = {}, {}
        for k, name in enumerate(names):
            parent = r.choice([None, "e" * 40, *names]) if k < 20 else names[k - r.randint(1, 20)]  # the first ones may be cycles, roots, or have unknown parents
            commits[name] = (parent, r.choice(words), r.choice([None, *[r.randint(0, 400_000) for _ in range(6)]]))
            if k % 12 == 11:
                merged[name] = (r.choice(["fix the index (#1)", "fix (#2)", "add T-0002 T-0003 (#4)", "more T-0001", None]), r.randint(0, 400_000))
        stored = [None, "(several)", "ABCDEF0", names[4][:9], names[9][:6], "0" * 12, f" {names[7]} ", *[n[: r.randint(7, 40)] for n in names]]
        frame = lambda rows, schema: spark.createDataFrame(rows, schema)
        got = failures.mapped_commits(
            frame([(s,) for s in stored + stored], "stored string"), frame([(k, *v) for k, v in commits.items()], COMMITS), frame([(k, *v, None, True) for k, v in merged.items()], MERGED)
        ).collect()
        assert sorted((repr(x["stored"]), x["merged_sha"], x["reason"]) for x in got) == sorted(((repr(s), *plain_mapping(s, commits, merged)) for s in set(stored)), key=lambda x: x[0])
        assert {x["reason"] for x in got} >= {"on_main", "subject_prefix", "first_parent", "unresolvable", "prose", "null"}


def test_the_next_of_a_key_with_many_days(spark):
    r = random.Random(7)
    asked = [(r.choice("ab"), r.choice([None, r.randint(0, 40) * 43_200])) for _ in range(60)]
    given = [(r.choice("ab"), r.choice([None, r.randint(0, 40) * 43_200]), f"s{k}") for k in range(25)]
    got = failures.next_at_or_after(spark.createDataFrame(asked, "k string, stamp long"), spark.createDataFrame(given, "k string, stamp long, sha string"), ["k"]).collect()
    want = {}
    for k, t in asked:
        found = [(u, s) for g, u, s in given if g == k and u is not None and (t is None or u >= t)]
        if found:
            want[(k, t)] = min(found)
    assert {(x["k"], x["stamp"]): (x["at"], x["carrier"]) for x in got} == want and len(got) == len(want)


def test_heads_by_edges_and_by_status(spark):
    rows = spark.createDataFrame([("a1", "F1", "archived"), ("a2", "F1", "active"), ("b1", "F2", "active"), ("b2", "F2", "archived"), ("c1", "F10", None), ("c2", "F10", "active"), ("d1", "F3", "archived")], "doc_id string, failure_id string, lifecycle_status string")
    edges = spark.createDataFrame([("a2", "a1"), ("b2", "b1"), ("zz", "c1"), ("b2", "b1")], "source_id string, target_id string")
    pick = lambda df: {r["failure_id"]: (r["head"], r["disagrees"], r["multiple"]) for r in df.collect()}
    assert pick(failures.chain_heads(rows, edges)) == {"F1": ("a2", False, False), "F2": ("b2", True, False), "F10": ("c1", False, True), "F3": ("d1", True, False)}
    assert pick(failures.chain_heads(rows, edges, prefer_archived=True))["F1"][0] == "a1"
    ids = spark.createDataFrame([("F100",), ("F2",), ("none",), ("F99",)], "failure_id string")
    assert [r[0] for r in ids.orderBy(failures.failure_order(ids["failure_id"])).collect()] == ["F2", "F99", "F100", "none"]


def test_rates_over_nothing_are_null(spark):
    heads = spark.createDataFrame([], "failure_id string, failure_class string, lifecycle_status string, document_date date, caught_by_gate boolean, introduction_commit string, fix_commit string, reached_main boolean, reached_main_present boolean, is_baseline boolean")
    merged, mapped = spark.createDataFrame([], MERGED), spark.createDataFrame([], "stored string, merged_sha string, reason string")
    found = failures.judged(heads, mapped, merged, "2024-01-01")
    row = failures.failure_metrics(found, merged).collect()
    assert len(row) == 1 and row[0]["merges"] == 0 and row[0]["escape_rate"] is None and row[0]["containment_rate"] is None
    assert failures.recurrence(found).collect() == []


def test_the_registered_log_meets_every_case(spark):
    sf = f"{DATA}/sf0.01"
    reasons = {r["reason"]: r["count"] for r in queries.q17_15_commit_mapping(spark, sf).groupBy("reason").count().collect()}
    assert set(reasons) == {"on_main", "subject_prefix", "ticket_id", "first_parent", "unresolvable", "prose", "null"}, reasons
    verdicts = {r["verdict"] for r in queries.q17_15_judgements(spark, sf).select("verdict").distinct().collect()}
    assert verdicts == {"contained", "escaped", "undetermined", "out_of_population"}


def test_the_texts_behind_commits_are_read_once(spark):
    """Commits are a written table to all that uses them, not a cut of every text each time (F20)."""
    commits, _ = queries._commits(spark, f"{DATA}/sf0.001")
    assert not any("documents.parquet" in f for f in commits.inputFiles())
