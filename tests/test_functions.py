"""Column functions and small operators on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from corvane.functions import text as t
from corvane.functions.jsonkeys import element_keys, json_type, typed_key
from corvane.operators import browse, evaluation, filters, graph, inference, lifecycle, passages, search
from corvane.operators.components import connected_components


def one(spark, expr, value=None):
    return spark.createDataFrame([(value,)], "x string").select(expr).first()[0]


@pytest.mark.parametrize(
    ("given", "folded"),
    [("a-b_c", "a b c"), ("PartNumber", "Part Number"), ("XMLFile", "XML File"), ("part2Number", "part2Number"), ("plain", "plain"), ("", "")],
)
def test_folding(spark, given, folded):
    assert one(spark, t.fold_for_query(F.col("x")), given) == folded


def test_folded_words_are_indexed(spark):
    for given in ("PartNumber of a-b", "x_y PartNo"):
        index = set(one(spark, t.expand_for_index(F.col("x")), given).split(" "))
        assert set(one(spark, t.fold_for_query(F.col("x")), given).split(" ")) <= index


@pytest.mark.parametrize(("given", "short"), [("Héllo, Wörld!", "hello_world"), ("  ", "untitled"), ("__a--b__", "a_b")])
def test_slug(spark, given, short):
    assert one(spark, t.slug(F.col("x")), given) == short


@pytest.mark.parametrize(("given", "out"), [("v1.2", "1.2"), ("1.2.3", "1.2.3"), ("v4", "4.0"), (None, "0.0")])
def test_versions(spark, given, out):
    assert one(spark, t.format_version(F.col("x")), given) == out


def test_cids_and_echo(spark):
    assert one(spark, t.readable_cids(F.col("x")), "a(cid:66)c(cid:7)") == "aBc(cid:7)"
    found = one(spark, t.structure_echo(F.col("x")), "# head\ntext\n- a\n\n- b\n- c\nend\n- lone")
    assert [(f["line"], f["kind"]) for f in found] == [(1, "heading"), (3, "list")]


def test_even_picks(spark):
    assert spark.range(1).select(t.even_picks(F.array(*[F.lit(k) for k in range(10)]), 4)).first()[0] == [0, 3, 6, 9]


def test_json_keys(spark):
    rows = spark.createDataFrame([('{"a":1}',), ('{"a":1.0}',), ('{"a":"1"}',), ('{"a":[1,"x",null]}',), ('{"a":null}',), ("{}",), (None,), ("bad{",)], "j string")
    got = rows.select(typed_key(F.col("j"), "a"), json_type(F.col("j"), "a"), element_keys(F.col("j"), "a")).collect()
    assert [r[0] for r in got[:3]] == ["n:1", "n:1", "s:1"]
    assert [r[1] for r in got] == ["number", "number", "string", "array", "null", None, None, None]
    assert got[3][2] == ["n:1", "s:x"]


def test_fusion_scores(spark):
    vector = spark.createDataFrame([("d1", 1), ("d2", 2), ("d3", 3)], "document_id string, rank int")
    keyword = spark.createDataFrame([("d2", 1), ("d4", 2)], "document_id string, rank int")
    got = search.reciprocal_rank_fusion([vector, keyword]).orderBy("rank").collect()
    assert [r["document_id"] for r in got] == ["d2", "d1", "d4", "d3"]
    assert got[0]["score"] == pytest.approx(1 / 62 + 1 / 61) and got[3]["score"] == pytest.approx(1 / 63)


def test_cosine_of_odd_vectors(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert [r[0] for r in rows.select(search.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0]


def test_cycles_and_forks(spark):
    docs = spark.createDataFrame([(x, x * 2) for x in "abcdefg"], "id string, source_content_hash string")
    rows = [("1", "b", "a"), ("2", "c", "b"), ("3", "e", "d"), ("4", "d", "e"), ("5", "f", "a")]
    edges = spark.createDataFrame([(i, s, d, "supersedes") for i, s, d in rows], "id string, source_id string, target_id string, edge_type string")
    assert sorted(r["ancestor"] for r in graph.lineage(docs, edges).where("id = 'd'").collect()) == ["d", "e"]
    heads = {r["chain"]: (r["heads"], r["head_id"]) for r in graph.chain_heads(docs, edges).collect()}
    assert heads == {"a": (2, None), "d": (0, None), "g": (1, "g")}
    steps = graph.traverse(edges, docs.where("id = 'd'").select("id"), depth=5).collect()
    assert sorted((r["depth"], r["to_id"], r["closes"]) for r in steps) == [(1, "e", False), (2, "d", True)]


def test_components_of_a_path_and_a_star(spark):
    rows = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 50)]
    got = connected_components(spark.createDataFrame(rows, "x long, y long"), "x", "y").collect()
    assert {r["component"] for r in got} == {0, 100} and len(got) == 91


def test_sections_and_splitting(spark):
    rows = [("d", 0, 0, "h", "a"), ("d", 1, 0, "h", "b"), ("d", 2, 1, "h2", "c"), ("d", 3, 0, "h", "e"), ("d", -1, None, "x", "skip")]
    p = spark.createDataFrame(rows, "document_id string, chunk_index int, section_index int, heading_path string, content string")
    assert passages.document_text(p).first()["text"] == "ab\n\nc\n\ne"
    text = "one\ntwo\r\n" + "x" * 25 + "\nend"
    pieces = passages.split_lines(spark.createDataFrame([("d", text), ("e", "")], "document_id string, text string"), 10).orderBy("piece").collect()
    assert "".join(r["text"] for r in pieces) == text and max(len(r["text"]) for r in pieces) <= 10


def test_filters_refuse_bad_requests(spark):
    with pytest.raises(ValueError):
        filters.in_scope("specific")
    with pytest.raises(ValueError):
        filters.document_filter({"provenance": {"nobody": 1}})
    with pytest.raises(ValueError):
        lifecycle.transitions(spark, [("a", "b", "c", False)])
    with pytest.raises(ValueError):
        evaluation.overlap_at_k(F.col("a"), F.col("b"), 0)


def test_derived_states():
    assert lifecycle.terminal_states() == {"relocated"}
    assert lifecycle.supersession_surviving() == {"active", "completed", "relocated"}


def test_rank_biased_overlap(spark):
    rows = spark.createDataFrame([(["a", "b"], ["a", "b"]), (["a"], ["b"]), ([], [])], "a array<string>, b array<string>")
    assert [round(r[0], 9) for r in rows.select(evaluation.rank_biased_overlap(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 1.0]


def test_fitting_prefix(spark):
    page = spark.createDataFrame([(k, "x" * 50) for k in range(1, 11)], "rank int, text string")
    assert browse.fitting_prefix(page, 300).count() == 4


def test_version_chain_removal(spark):
    items = spark.createDataFrame([("a", "T", "p", "r", "1.0", True), ("b", "t", "p", "r", "2.0", False), ("c", "T", "p", "r", None, False)], "id string, title string, project string, doc_type string, version string, is_new boolean")
    made = spark.createDataFrame([("1", "b", "c", "supersedes", "inferred:version_chain")], "id string, source_id string, target_id string, edge_type string, rationale string")
    add, gone = inference.version_chain_plan(items, made)
    assert sorted((r[0], r[1], r[2]) for r in add.collect()) == [("a", "c", 1), ("b", "a", 1)]
    assert [r["id"] for r in gone.collect()] == ["1"]
