"""The pipeline's stages, each against a plain version on its own input."""

import brute
import corpus_pipeline
import duckdb
from conftest import DATA
from test_operators import check_packing

from corvane.llm import quality

SF = f"{DATA}/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    score = {r["doc_id"]: r["score"] for r in quality.classify(docs, model).collect()}
    items = [(str(i), t) for i, t in duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()]
    for name, stage in corpus_pipeline.STAGES:
        rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        out = corpus_pipeline.materialize(stage(spark, docs, SF), name)
        if name == "best_fit_packing":
            check_packing(out.collect(), rows)
            return
        assert out.columns == columns
        if name == "quality_classifier":
            want = {i for i, _ in rows if score[i] >= quality.THRESHOLD}
        elif name == "ngram_jaccard_join":
            want = {i for i, _, c in brute.components(rows) if i == c}
        else:
            want = {r[0] for r in brute.contamination(rows, items) if not r[-1]}
        assert sorted(r[0] for r in out.select("doc_id").collect()) == sorted(want)
        docs = out
    raise AssertionError("the last stage packs")


def test_run_gives_the_last_stage(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns[:5] == ["doc_id", "piece", "start", "length", "ids_crc32"] and got.count() > 0


def test_empty_tables(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
