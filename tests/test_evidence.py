"""Evidence selection, abbreviated hashes, checks of abstracts and names, against plain versions."""

import hashlib
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from corvane.functions import audits
from corvane.operators import browse, selection

FACTS = "source string, region string, field string, place int, text string, tokens long"


def plain_selection(facts, max_excerpts, max_tokens, max_candidates, max_bytes):
    """One source: candidates by hash, excerpts round robin, tokens by equal shares, then what is left."""
    first, times = {}, {}
    for _, region, field, place, text, tokens in facts:
        if text and text.strip():
            times[text] = times.get(text, 0) + 1
            key = (place, region or "", field or "", tokens)
            first[text] = min(first.get(text, key), key)
    kept, size = {}, 0
    for k, text in enumerate(sorted(first, key=lambda t: (hashlib.sha256(t.encode()).hexdigest(), t))):
        size += len(text.encode())
        if k < max_candidates and size <= max_bytes:
            kept[text] = first[text]
    limits = ["candidate_retention"] if len(kept) < len(first) else []
    groups = {}
    for text, (place, region, field, tokens) in kept.items():
        groups.setdefault((region, field), []).append((place, text, tokens))
    for rows in groups.values():
        rows.sort()
    if len(kept) <= max_excerpts and sum(f[3] for f in kept.values()) <= max_tokens:
        chosen = list(kept)
    else:
        limits.append("selection_budget")
        slots, left = dict.fromkeys(groups, 0), min(max_excerpts, len(kept))
        while left:
            for key in sorted(groups):
                if left and slots[key] < len(groups[key]):
                    slots[key] += 1
                    left -= 1
        share, budget, chosen, pending = max_tokens // max(1, len(groups)), max_tokens, [], []
        for key in sorted(groups):
            rows, c, spent = groups[key], slots[key], 0
            places = range(len(rows)) if c >= len(rows) else [len(rows) // 2] if c == 1 else [i * (len(rows) - 1) // (c - 1) for i in range(c)]
            for k in places:
                if rows[k][2] <= share - spent:
                    spent += rows[k][2]
                    chosen.append(rows[k][1])
                else:
                    pending.append(rows[k])
            budget -= spent
        for _, text, tokens in pending:
            if tokens <= budget:
                budget -= tokens
                chosen.append(text)
    return sorted((*kept[t][:3], t, kept[t][3], times[t], limits) for t in chosen)


@pytest.mark.parametrize(("excerpts", "tokens", "candidates", "size"), [(5, 40, 100, 10_000), (3, 12, 8, 10_000), (12, 60, 100, 90), (200, 10_000, 1_000, 100_000), (1, 3, 100, 10_000)])
def test_selection(spark, excerpts, tokens, candidates, size):
    rng = random.Random(excerpts)
    rows = []
    for s in range(14):
        for place in range(rng.randrange(0, 30)):
            text = rng.choice([f"text {rng.randrange(25)}", " ", None, f"words {s} {place}"])
            rows.append((f"s{s:02d}", rng.choice(["a", "b", None]), rng.choice(["x", "y"]), place, text, rng.randrange(0, 14)))
    # A text says how many tokens it has.
    rows = [(s, r, f, p, t, len((t or "")) % 11) for s, r, f, p, t, _ in rows]
    found = selection.select_evidence(spark.createDataFrame(rows + [(None, "a", "x", 1, "lost", 1)], FACTS).repartition(3), excerpts, tokens, candidates, size).collect()
    for s in {r[0] for r in rows}:
        got = sorted((r["place"], r["region"], r["field"], r["text"], r["tokens"], r["repetitions"], r["limits"]) for r in found if r["source"] == s)
        assert got == plain_selection([r for r in rows if r[0] == s], excerpts, tokens, candidates, size), s
        assert sum(r[4] for r in got) <= tokens or not got[0][-1] or "selection_budget" not in got[0][-1]


def test_abbreviations(spark):
    hashes = spark.createDataFrame([(h,) for h in ("abcd1234", "abcd1299", "ABCE0000", "ffff0000", None, "ab")], "hash string")
    short = spark.createDataFrame([(a,) for a in ("abcd12", "abcd129", "abce", "ffff0000", "ffff00001", "abc", "", None, "ABCD1234", "9999")], "abbreviation string")
    got = {r["abbreviation"]: (r["status"], r["hash"], r["matches"]) for r in selection.resolve_abbreviations(short, hashes).collect()}
    assert got == {
        "abcd12": ("ambiguous", None, 2), "abcd129": ("resolved", "abcd1299", 1), "abce": ("resolved", "abce0000", 1), "ffff0000": ("resolved", "ffff0000", 1), "ffff00001": ("unknown", None, 0),
        "abc": ("too_short", None, 0), "": ("too_short", None, 0), "abcd1234": ("resolved", "abcd1234", 1), "9999": ("unknown", None, 0),
    }


OPENERS = [
    ("This document is a short report, and more. Next.", "report", ("is", "report")), ("The file serves as an accepted Report.", "report", ("serves as", "Report")), ("The document serves as a note.", "note", ("serves as", "note")),
    ("This page provides a note.", "note", None), ("This document is about a report.", "report", None), ("The text describes a work order-12 in short.", "work_order", ("describes", "work order-12")), ("This document, made in May, constitutes the report.", "report", ("constitutes", "report")),
    ("This document is an architecture decision record of May.", "adr", ("is", "architecture decision record")), ("This document is ADR-029.", "adr", ("is", "ADR-029")), ("The ticket-store document is here.", "ticket", None), ("This document describes a ticket-store.", "ticket", None),
    ("This document is one two three four five six report.", "report", None), ("This document is one two three four five report.", "report", ("is", "report")), ("This document lists things. It is a report.", "report", None), ("This document is a report.", None, None), ("", "report", None),
    ("This document acts boldly as a report.", "report", None), ("This document is “report”.", "report", ("is", "report")), (None, "report", None),
]


def test_openers(spark):
    rows = spark.createDataFrame([(k, t, d) for k, (t, d, _) in enumerate(OPENERS)], "k int, t string, d string")
    got = {r["k"]: r["f"] for r in rows.select("k", audits.type_opener(F.col("t"), F.col("d")).alias("f")).collect()}
    for k, (text, _, want) in enumerate(OPENERS):
        assert (tuple(got[k]) if got[k] else None) == want, text


REPAIRS = [  # text, type, what is left
    ("This document is a report that lists x. It is y.", "report", "This document lists x. It is y."), ("  The file serves as an ADR (ADR-1) which says  no.\n", "adr", "  The file says  no.\n"),
    ("This text describes a design note, which grew.", "design_note", "This text grew."), ("This document is a report, that, so to say, is x.", "report", None), ("This document is a report on x that is y.", "report", None),
    ("This document is a report (a b) that is y.", "report", None), ("This document is a report that", "report", None), ("This document is a report.", "report", None), ("A report that lists x.", "report", None),
    ("This document, e.g. mine, is \"the\" — new REPORT THAT shows it.", "report", "This document, e.g. mine, shows it."), ("This document is new. It is a report that is x.", "report", None), ("", "report", None), (None, "report", None), ("This document is a report that x.", None, None),
]


def test_repaired_openers(spark):
    rows = spark.createDataFrame([(k, t, d) for k, (t, d, _) in enumerate(REPAIRS)], "k int, t string, d string")
    got = {r["k"]: r["left"] for r in rows.select("k", audits.without_type_opener(F.col("t"), F.col("d")).alias("left")).collect()}
    for k, (text, _, want) in enumerate(REPAIRS):
        assert got[k] == (text if want is None else want), text


def test_recorded_findings(spark):
    cases = [
        ("AB-12 is old", "AB-12", []), ("ab-12 is old", "AB-12", ["unsupported_identifier"]), ("x AB-1", "", []), ("Three inspected  rows", None, ["bounded_structure"]), ("field: 3", "", ["bounded_structure"]), ("threerows", "", []),
        ("item0001 through end", "item0001", ["range_role"]), ("item0001 to end", "item0001 to end", []), ("item0001 to item0002", "item0001 item0002", []), (None, None, []), ("", "AB-12", []),
        ("item12345 TO Cd-77x, 10 columns", "", ["unsupported_identifier", "bounded_structure", "range_role"]),
    ]
    rows = spark.createDataFrame([(k, a, b) for k, (a, b, _) in enumerate(cases)], "k int, a string, b string")
    got = {r["k"]: r["f"] for r in rows.select("k", audits.recorded_findings(F.col("a"), F.col("b")).alias("f")).collect()}
    assert [got[k] for k in range(len(cases))] == [want for _, _, want in cases]


def spell(n):
    units = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
    tens = "x x twenty thirty forty fifty sixty seventy eighty ninety".split()
    small = lambda m: units[m] if m < 20 else tens[m // 10] + (f"-{units[m % 10]}" if m % 10 else "")
    return small(n) if n < 100 else f"{units[n // 100]} hundred" + (f" and {small(n % 100)}" if n % 100 else "")


def test_numbers_to_999(spark):
    rows = [(n, f"so {form} turns") for n in range(1, 1000) for form in {spell(n), spell(n).replace(" and ", " "), spell(n).replace("-", " "), str(n)}]
    found = spark.createDataFrame(rows, "n int, t string").select("n", "t", F.element_at(audits.numbers_at(F.split("t", " ")), -2).alias("x")).collect()
    assert [r["t"] for r in found if r["x"] is None or r["x"]["value"] != r["n"] or r["x"]["first"] != 1] == []


def test_turn_claims(spark):
    source = "\n".join(f"## Turn {k}" for k in range(1, 4)) + "\nhe said one hundred and six things"
    cases = {
        "It has three turns.": [], "It has 4 turns.": [("4 turns", 4, 3, False)], "There are one hundred and six turns.": [("one hundred and six turns", 106, 3, True)], "Some two hundred turns": [], "about three hundred and two turns": [],
        "at two hundred turns and 3 turns": [("two hundred turns", 200, 3, False)], "five one turn": [], "one turns around": [], "1 turn": [("1 turn", 1, 3, True)], "turns": [],
    }
    rows = spark.createDataFrame([(t,) for t in cases], "t string")
    got = {r["t"]: [tuple(x) for x in r["c"]] for r in rows.select("t", audits.turn_claims(F.col("t"), F.lit(source)).alias("c")).collect()}
    assert got == cases


def test_names_by_ratio(spark):
    names = ["User 1", "User 2", "Ursula", "Editor 3", "user one", "", "Зоя", None]
    frame = spark.createDataFrame([(str(k), n) for k, n in enumerate(names + ["Ursula"])], "key string, name string")
    for wanted in ("Usr 1", "ursla", "", "зоя", "xyz"):
        want = sorted({n for n in names if n is not None}, key=lambda n: (-SequenceMatcher(None, wanted.casefold(), n.casefold()).ratio(), n))[:3]
        assert [r["name"] for r in browse.nearest_names_by_ratio(frame, wanted).collect()] == want, wanted


def test_the_opener_is_judged_once_however_often_its_parts_are_used(spark):
    """What a value is used for does not copy the expression of it: a first sentence is cut out of the text once (F14)."""
    rows = spark.createDataFrame([("This document is a report that lists x.", "report")], "t string, d string")
    plan = rows.select(audits.without_type_opener(F.col("t"), F.col("d")).alias("left"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 2  # stretches of the text, words of the sentence
    assert plan.count("split(") <= 3


def test_texts_are_dealt_by_source_once(spark):
    """Both uses of the candidates read one exchange, the only one in which texts are (F19)."""
    rows = [(f"s{k % 3}", "a", "x", k, f"text {k}", 5) for k in range(40)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = selection.select_evidence(spark.createDataFrame(rows, FACTS), 5, 40)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert plan.count("- Exchange hashpartitioning") == 1 and plan.count("- ReusedExchange") == 1
