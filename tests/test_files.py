"""Markdown structure and file names by hand."""

import json

import pytest
from pyspark.sql import functions as F

from corvane.functions import names
from corvane.sources import files

MARKDOWN = """---
title: front
---
intro

# One #
text
### Deep
a
## Two
```
# in a fence
```
#
kept above
Under
===
b
"""


def test_sections(spark):
    docs = spark.createDataFrame([("v/a.md", MARKDOWN), ("v/b.md", "no heading"), ("v/c.md", None), ("v/d.md", "---\nopen rule\n# H"), ("v/e.md", "")], "path string, text string")
    got = {(r["path"][2], r["section"]): (r["title"], r["level"], r["heading_path"], r["content"]) for r in files.markdown_sections(docs).collect()}
    assert got == {
        ("a", 0): ("One", None, "", "intro"), ("a", 1): ("One", 1, "One", "text"), ("a", 2): ("One", 3, "One > Deep", "a"), ("a", 3): ("One", 2, "One > Two", "```\n# in a fence\n```\nkept above"), ("a", 4): ("One", 1, "Under", "b"),
        ("b", 0): ("b", None, "", "no heading"), ("d", 0): ("H", None, "", "---\nopen rule"), ("d", 1): ("H", 1, "H", ""),
    }


def test_passages_hold_their_heading_and_fit(spark):
    docs = spark.createDataFrame([("a.md", "# Head\n" + "\n".join(f"line {k} of it" for k in range(40))), ("b.md", "## " + "x" * 80 + "\n" + "y\n" * 100)], "path string, text string")
    rows = files.passages_of(files.markdown_sections(docs), 100).collect()
    a = [r["content"] for r in sorted((r for r in rows if r["path"] == "a.md"), key=lambda r: r["piece"])]
    assert len(a) > 5 and all(x.startswith("# Head\n\n") and len(x.encode()) <= 100 for x in a)
    assert "\n".join(x.removeprefix("# Head\n\n") for x in a) == "\n".join(f"line {k} of it" for k in range(40))
    assert sum(r["path"] == "b.md" for r in rows) == 1  # the heading alone takes most of the bound


@pytest.mark.parametrize(
    ("stem", "title", "date", "project", "codes", "version"),
    [
        ("2026-01-02_ACME_TD04_v1_1", "TD04", "2026-01-02", "ACME", ["TD04"], "v1.1"), ("ACME_2026-01-06_Some_Title_V8.2.0 copy 2", "Some_Title", "2026-01-06", "ACME", [], "v8.2.0"),
        ("2026-01-02 My Plan (1)", "My Plan", "2026-01-02", None, [], None), ("TD01_Notes_v3_FINAL", "Notes_FINAL", None, None, ["TD01"], "v3.0"), ("2026-01-02_v2", "2026-01-02_v2", "2026-01-02", None, [], "v2.0"),
        ("copy", "copy", None, None, [], None), ("x" * 1025, "x" * 1025, None, None, [], None), ("Title_TD9_2020-01-01_2021-01-01", "Title_2021-01-01", "2020-01-01", None, ["TD9"], None),
    ],
)
def test_names(spark, stem, title, date, project, codes, version):
    r = names.parsed_names(spark.createDataFrame([(stem,)], "stem string"), "stem", (r"TD\d+",)).first()["f"]
    assert (r["title"], r["date"], r["project"], r["codes"], r["version"]) == (title, date, project, codes, version)


def test_facts_and_records(spark):
    rows = [("a.jsonl", '{"a":{"b":[1,{"c":"x"}]},"d":null}\nnot json\n{"e":"2024-01-02"}'), ("b.json", '[{"k":1},{"k":2.50}]'), ("c.json", None)]
    records = files.json_records(spark.createDataFrame(rows, "path string, text string"))
    assert records.groupBy("path").count().orderBy("path").collect() == [("a.jsonl", 2), ("b.json", 2)]
    got = {(r["path"], r["field_path"], r["value"], r["kind"]) for r in files.facts(records).collect()}
    assert {("a.jsonl", "a.b[]", "1", "number"), ("a.jsonl", "a.b[].c", "x", "text"), ("a.jsonl", "e", "2024-01-02", "date"), ("b.json", "k", "1", "number")} <= got
    refused = {(r["path"], r["kind"]) for r in files.facts(records, depth=0).where("value is null").collect()}
    assert refused and all(kind == "depth_reached" for _, kind in refused)


def test_facts_at_any_depth(spark):
    """Deep values are found, bounds are reported for the record that passes them, other records stay whole."""
    deep = '{"a":' * 40 + "1" + "}" * 40
    rows = [("x", 0, '{"a":{"b":{"c":{"d":{"e":{"f":{"g":1}}}}}},"z":2}'), ("y", 0, deep), ("l", 0, "[1, [2, [3]]]"), ("n", 0, '{"e": {}, "l": [], "v": null}')]
    records = spark.createDataFrame(rows, "path string, record int, text string")
    got = {(r["path"], r["field_path"]): (r["value"], r["kind"]) for r in files.facts(records).collect()}
    assert got["x", "a.b.c.d.e.f.g"][0] == "1" and got["x", "z"][0] == "2" and got["y", ".".join("a" * 40)][0] == "1"
    assert {k for k in got if k[0] == "l"} == {("l", "[]"), ("l", "[][]"), ("l", "[][][]")} and got["n", "v"] == (None, "null")
    short = {(r["path"], r["field_path"]): r["kind"] for r in files.facts(records, depth=10).collect()}
    assert [k for k in short if k[0] == "y"] == [("y", "")] and short["y", ""] == "depth_reached" and ("x", "a.b.c.d.e.f.g") in short
    few = {(r["path"], r["kind"]) for r in files.facts(records, most_nodes=2).collect() if r["path"] == "l"}
    assert few == {("l", "nodes_reached")}


def test_facts_of_small_records_are_not_shuffled(spark):
    """Records too short to have too many facts are not counted, and facts are not dealt anew to drop the refused ones (F18)."""
    records = files.json_records(spark.createDataFrame([("a.json", '{"a": [1, {"b": "x"}]}'), ("b.json", " \n[1, 2]"), ("c.json", '"["')], "path string, text string"))
    found = files.facts(records)
    assert {tuple(r)[:4] for r in found.collect()} == {("a.json", 0, "a[]", "1"), ("a.json", 0, "a[].b", "x"), ("b.json", 0, "", "1"), ("b.json", 1, "", "2"), ("c.json", 0, "", "[")}
    assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()


def test_malformed_records(spark):
    rows = [("a.jsonl", '{"x": 1}\n\nnot json\n{"x": 2}\n{'), ("b.json", "{oops"), ("c.json", "[1]"), ("d.json", None)]
    found = files.malformed_records(spark.createDataFrame(rows, "path string, text string")).collect()
    assert sorted(map(tuple, found)) == [("a.jsonl", 3, "not json"), ("a.jsonl", 5, "{"), ("b.json", 0, "{oops")]


def test_delimited_rows(spark):
    rows = [
        ("a.csv", '\ufeffname,"the ""note""",name\r\n"x, y","two\nlines",1\n\nlast,,\rmore,1,2,3\nshort'), ("b.tsv", 'a\tb,c\n"1\t2"\t3'), ("c.csv", 'a,b\n1,2\n3,"open\n5,6'), ("d.csv", 'a\nx"y"z\n2'), ("e.csv", None), ("f.csv", ""),
    ]
    frame = spark.createDataFrame(rows, "path string, text string")
    got = {}
    for r in sorted(files.delimited_rows(frame).collect()):
        got.setdefault(r["path"], []).append(list(r["fields"]) if r["well_formed"] else None)
    assert got["a.csv"] == [["name", 'the "note"', "name"], ["x, y", "two\nlines", "1"], ["last", "", ""], ["more", "1", "2", "3"], ["short"]]
    assert got["b.tsv"] == [["a", "b,c"], ["1\t2", "3"]] and got["d.csv"] == [["a"], None, ["2"]] and "e.csv" not in got and "f.csv" not in got
    assert got["c.csv"][:2] == [["a", "b"], ["1", "2"]] and None in got["c.csv"]
    records = {(r["path"], r["record"]): json.loads(r["text"]) for r in files.delimited_records(frame).collect()}
    assert records["a.csv", 0] == {"name": "x, y", 'the "note"': "two\nlines", "name_3": "1"} and records["a.csv", 2]["column_4"] == "3" and records["a.csv", 3] == {"name": "short"}
    assert records["b.tsv", 0] == {"a": "1\t2", "b,c": "3"} and records["d.csv", 1] == {"a": "2"}
