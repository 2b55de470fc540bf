"""Keyword queries by hand: words, phrases, OR, exclusions, folding, and advice."""

import pyarrow as pa
import pytest

from corvane.functions.stem import stem_array, stem_word
from corvane.operators import keyword, keyword_index

PASSAGES = [
    ("a", 0, "The quick brown fox."), ("a", 1, "It jumps over lazy dogs."), ("b", 0, "A lazy dog sleeps; the brown bear too."), ("c", 0, "Quick foxes, brown classes"), ("c", 1, "policies of the bus"),
    ("d", -1, "quick brown fox dogs"), ("d", 0, None),
]
SURFACES = [("a", "Notes", "fox dog dog"), ("b", "red-team PlanB", None), ("c", "quick notes", "bear"), ("d", "Ant hill", "fox")]


@pytest.fixture(scope="module")
def tables(spark):
    return spark.createDataFrame(PASSAGES, "document_id string, chunk_index int, content string").repartition(3), spark.createDataFrame(SURFACES, "document_id string, matchable string, orienting string")


@pytest.fixture(scope="module")
def index(tables):
    return keyword_index.build(*tables)


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("quick dog", ["a"]),  # from two passages
        ("fox", ["a", "c"]),  # plural endings; derived text of d never matches, nor does its header row
        ('"brown fox"', ["a"]), ('"quick brown"', ["a"]), ("fox OR bear", ["a", "b", "c"]), ("brown -fox", ["b"]), ("-brown", ["a", "b", "c", "d"]), ("quick notes", ["a", "c"]),
        ("red team", ["b"]), ("ant-hill", ["d"]), ("the of", []), ("policy", ["c"]), ("class bus", ["c"]), ('"dogs sleep"', ["b"]), ('"dog jumps"', []),
    ],
)
def test_matches(index, query, want):
    assert sorted(r["document_id"] for r in keyword_index.search(index, query).collect()) == want


def test_scores(tables):
    got = {r["document_id"]: r for r in keyword.keyword_search(*tables, "fox OR dog").collect()}
    # The surface of a holds both in its derived text: 1 for fox, 1 + 1/4 for dog.
    assert got["a"]["score"] == pytest.approx((1 + 1.25) / keyword.BASEL / 2)
    assert got["b"]["score"] == pytest.approx(0.1 / keyword.BASEL / 2) and got["b"]["chunk_index"] == 0
    assert got["a"]["matched_passages"] == 2


@pytest.mark.parametrize(
    "query",
    ["quick dog", '"quick brown" OR bear', 'fox OR "lazy dog" -sleep', '-"lazy dog"', "planB", "red-team", ""],
)
def test_index_gives_what_a_scan_gives(tables, index, query):
    """Matches, scores, best passages and counts, with a limit on documents and without."""
    shown = lambda df: sorted((r["document_id"], round(r["score"], 9), r["chunk_index"] if query[:1] != "-" else None, r["matched_passages"]) for r in df.collect())
    assert shown(keyword_index.search(index, query)) == shown(keyword.keyword_search(*tables, query))


def test_only_visible_documents(tables, index):
    some = tables[1].where("document_id <> 'a'").select("document_id")
    assert sorted(r["document_id"] for r in keyword_index.search(index, "fox OR lazy", some).collect()) == ["b", "c"]
    assert sorted(r["document_id"] for r in keyword_index.search(index, "-lazy", some).collect()) == ["b", "c", "d"]


def test_many_queries_in_one_plan(spark, tables, index):
    texts = ["quick dog", "red-team", "fox", "planB", "the", "brown", "absent fox", "Ant hill", "brown bear too", "", None]
    found = keyword_index.search_many(index, spark.createDataFrame([(t,) for t in [*texts, "fox"]], "text string"), 2).collect()
    got = {}
    for r in sorted(found, key=lambda r: r["rank"]):
        got.setdefault(r["text"], []).append((r["document_id"], r["score"], r["rank"]))
    for text in texts:
        one = sorted(keyword_index.search(index, text or "").collect(), key=lambda r: (-round(r["score"], 9), r["document_id"]))[:2]
        assert got.get(text, []) == [(r["document_id"], round(r["score"], 9), k + 1) for k, r in enumerate(one)], text


def test_index_of_nothing(spark, tables):
    empty = keyword_index.build(*(t.limit(0) for t in tables))
    assert keyword_index.search(empty, "fox").count() == 0 and keyword_index.search(empty, "-fox").count() == 0
    assert keyword_index.search_many(empty, spark.createDataFrame([("fox",)], "text string"), 3).count() == 0


def test_a_search_reads_only_its_lexemes(index):
    """The lexemes of a query reach the scan; no text is read."""
    plan = keyword_index.search(index, "quick dog")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(lexeme, [dog,quick])" in plan.replace("IsNotNull(lexeme), ", "") or "In(lexeme" in plan
    assert "content" not in plan


def test_title_ranks(spark, index):
    titles = spark.createDataFrame([("a", "Notes"), ("b", "red-team PlanB"), ("c", "quick notes"), ("d", "Ant hill"), ("x", "quick notes"), ("y", None)], "document_id string, title string")
    got = {(r["rendering"], r["document_id"]): r["rank"] for r in keyword_index.title_ranks({"now": index}, titles, 1).collect()}
    assert got["verbatim", "d"] == 1 and got["uppercase", "d"] == 1 and got["compound", "d"] == 1  # antHill folds to ant Hill
    assert got["verbatim", "c"] == 1 and got["verbatim", "x"] is None and ("verbatim", "y") not in got and ("compound", "a") not in got
    summary = {r["rendering"]: (r["eligible"], r["rank_1"], r["recalled"]) for r in keyword_index.title_rank_summary(keyword_index.title_ranks({"now": index}, titles, 5)).collect()}
    assert summary["compound"][0] == 3 and summary["verbatim"][0] == 5


def test_parse_and_advice():
    q = keyword.parse('the "state of" plan OR -draft notes')
    assert q.branches == [[("state", "of"), ("plan",)], [("note",)]] and q.excluded == [("draft",)] and q.dropped == ["the"]
    assert keyword.forms("red-team PlanPort")[1] == "red team Plan Port" and keyword.forms("plain words")[1] is None
    assert keyword.advice("fox", 3) == [] and keyword.advice("the", 0) == ["only common words: the"]


def _shuffled(spark):
    """Bytes that all stages so far wrote for shuffles."""
    rows = spark._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
    return sum(s.shuffleWriteBytes() for s in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(rows))


def test_an_index_is_built_without_dealing_its_words(spark):
    """Occurrences are grouped where they are read; only the lexicon's counts are shuffled."""
    rows = spark.range(400).selectExpr("concat('d', id) document_id", "0 chunk_index", "concat_ws(' ', transform(sequence(1, 500), k -> concat('w', k * (id + 7) % 97))) content").repartition(2).localCheckpoint()
    before = _shuffled(spark)
    index = keyword_index.build(rows, spark.createDataFrame([], "document_id string, matchable string, orienting string"))
    assert _shuffled(spark) - before < 20_000
    assert index.postings.selectExpr("sum(hits)", "sum(size(positions))").first()[:] == (200_000, 200_000)


def test_runs_are_sorted_and_whole(monkeypatch):
    """Units of several runs, one without words, one whose last words only rank."""
    monkeypatch.setattr(keyword_index, "RUN", 6)
    units = [("a", 0, "dogs fox dog", 9), ("b", 1, "", 9), ("c", None, "fox bears fox dog", 2), ("d", 0, "fox", 9)]
    batch = pa.RecordBatch.from_arrays([pa.array([u[k] for u in units], t) for k, t in enumerate((pa.string(), pa.int32(), pa.string(), pa.int32()))], ["document_id", "chunk_index", "said", "own"])
    runs = [r for b in (batch.slice(0, 3), batch.slice(3)) for r in keyword_index._runs(iter([b]))]
    got = [[tuple(r.values()) for r in run.to_pylist()] for run in runs]
    assert got == [
        [("bear", "c", None, [1], 1), ("dog", "a", 0, [0, 2], 2), ("dog", "c", None, [], 1), ("fox", "a", 0, [1], 1), ("fox", "c", None, [0], 2)],
        [("fox", "d", 0, [0], 1)],
    ]


def test_stems_of_arrays():
    said = [*"generously communism dying ties flies agreed hopping fizzed toy happy geologi fluently us y ab12s adoption formative enjoyed boyish earrings sky".split(), "", "controll", "a" * 40 + "ement"]
    assert stem_array(pa.array(said)).to_pylist() == [stem_word(w) for w in said]


def test_lexemes_batch_by_batch(spark):
    rows = spark.createDataFrame([("The quick Foxes' policies, 12 dogs!",), ("",), (None,), ("-- ",), ("Running-classes running",)], "t string").repartition(2)
    both = rows.select(keyword.lexemes(rows.t).alias("a"), keyword.lexemes_of(rows.t).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in both) and sum(len(r["b"]) for r in both) == 9
