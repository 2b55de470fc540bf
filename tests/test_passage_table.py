"""Publications into the bucketed table: fence, untouched files, coverage."""

import os

import pytest
from pyspark.sql import functions as F

from corvane.operators.passage_table import PassageTable


def files(path):
    """{bucket: names of its files}"""
    return {d: sorted(f for f in os.listdir(f"{path}/{d}") if f.endswith(".parquet")) for d in os.listdir(path) if d.startswith("bucket=")}


def rows(table):
    return sorted((r["document_id"], r["chunk_index"], r["content"], r["attempt"]) for r in table.passages().collect())


@pytest.fixture
def table(spark, tmp_path):
    passages = spark.createDataFrame([(f"d{k:02d}", c, f"text {k} {c}") for k in range(30) for c in range(k % 4)] + [(None, 0, "lost")], "document_id string, chunk_index int, content string")
    return PassageTable.create(passages, f"file://{tmp_path}/table", 8)


def publication(spark, items):
    return spark.createDataFrame(items, "document_id string, attempt long"), spark.createDataFrame([(d, a, c, f"new {a} {c}") for d, a in items for c in range(2)], "document_id string, attempt long, chunk_index int, content string")


def test_publish(spark, table, tmp_path):
    before, first = files(f"{tmp_path}/table"), rows(table)
    got = {tuple(r) for r in table.publish(*publication(spark, [("d05", 2), ("d06", 1), ("d07", 0), ("x99", 1), ("d09", 3), ("d09", 2)])).collect()}
    assert got == {("d05", 2, "published"), ("d06", 1, "repeated"), ("d07", 0, "stale"), ("x99", 1, "published"), ("d09", 3, "published"), ("d09", 2, "stale")}
    changed = {"d05": 2, "x99": 1, "d09": 3}
    assert rows(table) == sorted([r for r in first if r[0] not in changed] + [(d, c, f"new {a} {c}", a) for d, a in changed.items() for c in range(2)])
    after = files(f"{tmp_path}/table")
    touched = {r["b"] for r in spark.createDataFrame([(d,) for d in changed], "document_id string").select(table._bucket().alias("b")).collect()}
    assert {b for b in before if before[b] != after[b]} == {f"bucket={b}" for b in touched}
    # The same publication once more, and a stale one: no file changes.
    again = {r["outcome"] for r in table.publish(*publication(spark, [("d05", 2), ("x99", 1), ("d09", 3), ("d05", 1)])).collect()}
    assert again == {"repeated", "stale"} and files(f"{tmp_path}/table") == after


def test_document_without_passages(spark, table):
    requests, _ = publication(spark, [("d07", 5)])
    none = spark.createDataFrame([("d07", 4, 0, "of another attempt"), ("d07", 5, None, "no place")], "document_id string, attempt long, chunk_index int, content string")
    table.publish(requests, none)
    assert [r for r in rows(table) if r[0] == "d07"] == [] and table.states().where("document_id = 'd07'").collect() == [("d07", 5, False)]
    assert {r["outcome"] for r in table.publish(requests, none).collect()} == {"repeated"}


def test_coverage(spark, table, tmp_path):
    table.publish(*publication(spark, [("d05", 2), ("d06", 2)]))
    assert {r["document_id"] for r in table.states().where("not vectors_current").collect()} == {"d05", "d06"}
    before, kept = files(f"{tmp_path}/table"), rows(table)
    found = {tuple(r) for r in table.cover(spark.createDataFrame([("d05", 2), ("d06", 1), ("d11", 1), ("nobody", 1)], "document_id string, attempt long")).collect()}
    assert found == {("d05", "covered"), ("d06", "stale"), ("d11", "repeated"), ("nobody", "stale")}
    assert {r["document_id"] for r in table.states().where("not vectors_current").collect()} == {"d06"} and rows(table) == kept
    bucket = spark.createDataFrame([("d05",)], "document_id string").select(table._bucket().alias("b")).first()["b"]
    assert {b for b, f in files(f"{tmp_path}/table").items() if before[b] != f} == {f"bucket={bucket}"}


def test_only_touched_buckets_are_read(table):
    plan = table.rows().where(F.col("bucket").isin([1, 2]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan


def test_empty(spark, tmp_path):
    table = PassageTable.create(spark.createDataFrame([("a", 0, "x")], "document_id string, chunk_index int, content string"), f"file://{tmp_path}/one", 4)
    assert table.publish(*publication(spark, [])).count() == 0 and len(rows(table)) == 1
    with pytest.raises(Exception):
        PassageTable.create(table.passages(), f"file://{tmp_path}/one", 4)
