"""A table of passages that writes commit to: buckets, an attempt fence, coverage.

The table is a folder of Parquet files partitioned by a hash bucket of the document.
Every document has a state row (no ``chunk_index``) with the attempt that last published
it and whether its vectors still stand for its text; its passages carry the same
attempt.  A publication rewrites the buckets of the documents it changes by Spark's
dynamic partition overwrite and leaves the files of all others as they are; where the
fence lets nothing through, no file is written.

One writer at a time is assumed, as there is no catalogue to lock.  The new buckets
are written to the shared folder first, so a lost executor costs only its tasks and
a failed publication leaves the table as it was.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.lineage import discard, materialize

_STATE = ("document_id", "attempt", "vectors_current")


@dataclass(frozen=True)
class PassageTable:
    spark: SparkSession
    path: str
    buckets: int

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("document_id"), F.lit(self.buckets)).cast("int")

    def rows(self) -> DataFrame:
        """State rows and passages with their bucket."""
        return self.spark.read.parquet(self.path)

    def passages(self) -> DataFrame:
        return self.rows().where("chunk_index is not null").drop("vectors_current", "bucket")

    def states(self) -> DataFrame:
        """(document_id, attempt, vectors_current) of every published document, also of those without passages."""
        return self.rows().where("chunk_index is null").select(*_STATE)

    @classmethod
    def create(cls, passages: DataFrame, path: str, buckets: int = 64, attempt: int = 1) -> PassageTable:
        """Write a new table of passages (document_id, chunk_index, ...); it is an error if something is there."""
        table = cls(passages.sparkSession, path.rstrip("/"), buckets)
        rows = passages.where("document_id is not null and chunk_index is not null").withColumn("attempt", F.lit(attempt).cast("long"))
        table._write(table._with_states(rows, rows.select("document_id", "attempt").distinct(), True), "errorifexists")
        return table

    def _with_states(self, rows: DataFrame, documents: DataFrame, current: bool) -> DataFrame:
        states = documents.withColumn("vectors_current", F.lit(current))
        return rows.withColumn("vectors_current", F.lit(None).cast("boolean")).unionByName(states, allowMissingColumns=True).withColumn("bucket", self._bucket())

    def _write(self, rows: DataFrame, mode: str) -> None:
        # A bucket is written by one task, or by several if it is large.
        ordered = rows.repartition("bucket", F.pmod(F.xxhash64("document_id"), F.lit(8))).sortWithinPartitions("bucket", "document_id", "chunk_index")
        ordered.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)

    def fence(self, requests: DataFrame) -> DataFrame:
        """(document_id, attempt, outcome) of requests (document_id, attempt): published for a later attempt than the last, repeated, or stale.

        Of several attempts for a document only the latest may be published.
        """
        newest = Window.partitionBy("document_id")
        asked = requests.where("document_id is not null and attempt is not null").select("document_id", F.col("attempt").cast("long")).distinct().withColumn("top", F.max("attempt").over(newest))
        held = self.states().select("document_id", F.col("attempt").alias("held"))
        judged = asked.join(held, "document_id", "left")
        outcome = F.when(F.col("attempt") < F.col("top"), "stale").when(F.col("held").isNull() | (F.col("attempt") > F.col("held")), "published").when(F.col("attempt") == F.col("held"), "repeated").otherwise("stale")
        return judged.select("document_id", "attempt", outcome.alias("outcome"))

    def publish(self, requests: DataFrame, incoming: DataFrame) -> DataFrame:
        """Replace the passages of the documents that requests (document_id, attempt) name by incoming ones (with attempt); the fence's outcomes.

        A document without incoming passages of its attempt keeps its state row only.
        What is published no longer has current vectors.
        """
        outcomes = materialize(self.fence(requests), "outcomes")
        done = outcomes.where("outcome = 'published'").select("document_id", "attempt")
        touched = [r["bucket"] for r in done.select(self._bucket().alias("bucket")).distinct().collect()]  # at most ``buckets`` numbers
        if touched:
            old = self.rows().where(F.col("bucket").isin(touched)).join(done.select("document_id"), "document_id", "left_anti")
            new = incoming.where("chunk_index is not null").withColumn("attempt", F.col("attempt").cast("long")).join(done, ["document_id", "attempt"], "left_semi")
            self._replace(old.unionByName(self._with_states(new, done, False), allowMissingColumns=True))
        return outcomes

    def cover(self, embedded: DataFrame) -> DataFrame:
        """Vectors now stand for the text of documents (document_id, attempt), where the attempt is still the last: document_id, outcome (covered, repeated, stale)."""
        held = self.states().withColumnRenamed("attempt", "held")
        judged = embedded.select("document_id", F.col("attempt").cast("long")).distinct().join(held, "document_id", "left")
        outcome = F.when(~F.coalesce(F.col("attempt") == F.col("held"), F.lit(False)), "stale").when(F.col("vectors_current"), "repeated").otherwise("covered")
        outcomes = materialize(judged.select("document_id", outcome.alias("outcome")), "outcomes")
        done = outcomes.where("outcome = 'covered'").select("document_id").distinct()
        touched = [r["bucket"] for r in done.select(self._bucket().alias("bucket")).distinct().collect()]  # at most ``buckets`` numbers
        if touched:
            rows = self.rows().where(F.col("bucket").isin(touched)).join(done.withColumn("done", F.lit(True)), "document_id", "left")
            self._replace(rows.withColumn("vectors_current", F.when(F.col("chunk_index").isNull(), F.coalesce("done", "vectors_current"))).drop("done"))
        return outcomes

    def _replace(self, rows: DataFrame) -> None:
        """Overwrite the buckets that these rows are of: the rows are read from the table, so they are written aside first."""
        aside = materialize(rows.select(*self.rows().columns), "buckets")
        self._write(aside, "overwrite")
        discard(aside)
