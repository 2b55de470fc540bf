"""Streams of files and events: an intake that judges each micro-batch, and windowed timings with late data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.names import source_type
from ..operators.maintenance import intake


def timings(events: DataFrame, late: str = "1 hour", window: str = "1 hour") -> DataFrame:
    """start, event_type, n, most and total of each window of a stream (ts, event_type, value).

    Events later than ``late`` behind the latest one seen are left out, so state stays
    bounded by the windows that are still open.  It is the same on a table.
    """
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type")
    return rows.agg(F.count("*").alias("n"), F.max("value").alias("most"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "most", "total")


def emitted(events: DataFrame, emit_ms: float, warn_ms: float) -> DataFrame:
    """The measurements (ts, layer, label, duration) that are written at once, with their level: those of ``emit_ms`` and more, WARNING above ``warn_ms``, else DEBUG."""
    level = F.when(F.col("duration") > warn_ms, "WARNING").otherwise("DEBUG")
    return events.where(F.col("duration") >= emit_ms).select("ts", "layer", "label", "duration", level.alias("level"))


def summaries(events: DataFrame, emit_ms: float, warn_ms: float, every: str = "60 seconds", late: str = "1 minute", accuracy: int = 400) -> DataFrame:
    """Per layer, label and ``every`` of event time: start, n, suppressed (below ``emit_ms``), warned (above ``warn_ms``), longest and a sketch of the durations.

    On a stream a summary is given once its interval is ``late`` behind the latest measurement; it is the same on a table.  State is
    a row for each open interval, layer and label, and counts are added up before they are shuffled, so a busy layer is
    no busy task.  Measurements without a time or a duration do not count.  The sketch (KLL) answers ranks within about
    4 / ``accuracy`` of the count, also after merging.
    """
    rows = events.where("ts is not null and duration is not null").withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), "layer", "label")
    d = F.col("duration").cast("double")
    found = rows.agg(F.count("*").alias("n"), F.count_if(d < emit_ms).alias("suppressed"), F.count_if(d > warn_ms).alias("warned"), F.max(d).alias("longest"), F.kll_sketch_agg_double(d, accuracy).alias("sketch"))
    return found.select(F.col("w.start").alias("start"), "layer", "label", "n", "suppressed", "warned", "longest", "sketch")


def rolled_up(found: DataFrame, by: list[str], ranks: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Summaries of any intervals put together by some of their columns: ``by``, n, suppressed, warned, longest, quantiles (of the ``ranks``, from merged sketches).

    No measurement is read again.
    """
    rows = found.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("suppressed").alias("suppressed"), F.sum("warned").alias("warned"), F.max("longest").alias("longest"), F.kll_merge_agg_double("sketch").alias("sketch"))
    return rows.select(*by, "n", "suppressed", "warned", "longest", F.kll_sketch_get_quantile_double("sketch", F.array(*map(F.lit, ranks))).alias("quantiles"))


def intake_stream(files: DataFrame, known: Callable[[], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Verdicts of a stream of files (path, hash) against the documents known at each micro-batch, as Parquet by batch.

    A batch that is run again after a stop writes the same folder, so no verdict
    is there twice.  All files that have arrived are taken, then the query ends.
    """

    def judge(batch: DataFrame, number: int) -> None:
        intake(batch.select("path", "hash"), known(), source_type(F.col("path"))).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return files.writeStream.foreachBatch(judge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
