"""Cutting lineage through tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting that removes shuffle files at the end of a query.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCK = threading.Lock()
_WRITING: dict[str, tuple[int, str | None]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``.

    Where that is unset, a folder of our own serves a session on one machine; on a
    cluster, whose machines would not see it, that is an error.
    """
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not place:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="corvane-")
        spark.sparkContext.setCheckpointDir(place)
    return place.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/corvane/{name}-{uuid.uuid4().hex}"


@contextmanager
def _cleaning(spark: SparkSession) -> Iterator[None]:
    """The clean-up setting is on while any thread of the session writes; the last one puts it back."""
    key = spark.sparkContext.applicationId + str(id(spark._jsparkSession))
    with _LOCK:
        n, before = _WRITING.get(key) or (0, spark.conf.get(_CLEANUP, None))
        _WRITING[key] = n + 1, before
        spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        with _LOCK:
            n, before = _WRITING.pop(key)
            if n > 1:
                _WRITING[key] = n - 1, before
            elif before is None:
                spark.conf.unset(_CLEANUP)
            else:
                spark.conf.set(_CLEANUP, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Any executor can read the table again, so nothing before it is ever computed
    twice, whatever executors are lost.  Once it is written, Spark removes the
    shuffle files that led to it.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with _cleaning(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``materialize`` gave, once nothing will read them any more."""
    for table in tables:
        spark = table.sparkSession
        own = f"{shared_dir(spark)}/corvane/".split(":")[-1].lstrip("/")
        for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
            if own in folder:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
