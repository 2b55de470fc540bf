"""Streams give what the same tables give at once."""

from conftest import DATA
from pyspark.sql import functions as F

from corvane.functions.names import source_type
from corvane.operators.maintenance import intake
from corvane.streaming import feeds


def test_timings_of_a_stream(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/sf0.001/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    query = feeds.timings(stream).writeStream.format("memory").queryName("timings").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = lambda df: sorted(tuple(r)[:3] for r in df.collect())
    assert rows(spark.table("timings")) == rows(feeds.timings(events)) != []


def test_summaries_of_a_stream_and_their_quantiles(spark, tmp_path):
    rows = spark.read.parquet(f"{DATA}/sf0.01/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), F.lit("storage").alias("layer"), F.col("event_type").alias("label"), F.col("value").alias("duration"))
    odd = spark.createDataFrame([(None, "storage", "view", 3.0), ("2024-01-01 00:00:00", "storage", "view", None)], "ts string, layer string, label string, duration double").withColumn("ts", F.col("ts").cast("timestamp"))
    events = rows.unionByName(odd)
    late = spark.createDataFrame([("2030-01-01 00:00:00", "end", "end", 1.0)], "ts string, layer string, label string, duration double").withColumn("ts", F.col("ts").cast("timestamp"))
    events.unionByName(late).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    summed = feeds.summaries(stream, 5.0, 40.0, every="1 day")
    query = summed.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    got, want = spark.read.parquet(f"{tmp_path}/out").where("layer = 'storage'"), feeds.summaries(events, 5.0, 40.0, every="1 day")
    plain = lambda df: sorted(tuple(r) for r in df.drop("sketch").collect())
    assert plain(got) == plain(want) != []
    loud = feeds.emitted(events, 5.0, 40.0).collect()
    assert len(loud) == sum(r["n"] - r["suppressed"] for r in got.collect()) and sum(r["level"] == "WARNING" for r in loud) == sum(r["warned"] for r in got.collect())
    for row in feeds.rolled_up(got, ["label"]).collect():
        values = sorted(r["duration"] for r in rows.where(F.col("label") == row["label"]).collect())
        assert row["n"] == len(values) and row["longest"] == values[-1]
        for rank, value in zip((0.5, 0.95, 0.99), row["quantiles"]):
            assert sum(v < value for v in values) / len(values) - 0.01 <= rank <= sum(v <= value for v in values) / len(values) + 0.01


def test_intake_of_a_stream(spark, tmp_path):
    docs = spark.createDataFrame([("d1", "a.md", "h1"), ("d2", "b.md", "h2")], "id string, source_path string, source_content_hash string")
    files = spark.createDataFrame([("a.md", "new"), ("x.md", "h2"), ("y.eml", "z"), ("c.md", "q"), ("d.md", "q")], "path string, hash string")
    files.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(files.schema).parquet(f"{tmp_path}/in")
    feeds.intake_stream(stream, lambda: docs, f"{tmp_path}/out", f"{tmp_path}/c").awaitTermination()
    got = {(r["path"], r["verdict"], r["document_id"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {tuple(r) for r in intake(files, docs, source_type(F.col("path"))).collect()}
    assert {v for _, v, _ in got} == {"would_supersede", "duplicate", "unsupported", "would_create", "duplicate_in_batch"}
