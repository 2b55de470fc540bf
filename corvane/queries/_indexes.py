"""Indexes that several queries share: built once for a session and folder of tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import indexed_structure
from ..operators import keyword, keyword_index, vector_index
from ..sources import graph_tables as g

_BUILT: dict[tuple, object] = {}
DIM = 64


def _once(spark, sf_dir: str, name: str, make):
    """Tables in a folder do not change while a session reads them; another session or folder has its own index."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _BUILT:
        _BUILT[key] = make()
    return _BUILT[key]


def keywords(spark, sf_dir: str) -> keyword_index.KeywordIndex:
    return _once(spark, sf_dir, "keyword", lambda: keyword_index.build(g.passages(spark, sf_dir), keyword.surfaces(g.documents(spark, sf_dir))))


def addressed_keywords(spark, sf_dir: str) -> keyword_index.KeywordIndex:
    """The index in which every passage carries its whole heading path."""
    return _once(spark, sf_dir, "addressed", lambda: keyword_index.build(g.passages(spark, sf_dir).withColumn("content", _headed("heading_path")), keyword.surfaces(g.documents(spark, sf_dir))))


def structured_keywords(spark, sf_dir: str) -> keyword_index.KeywordIndex:
    """The index in which every passage carries its heading path without the document's title."""
    rows = g.passages(spark, sf_dir)
    rows = rows.withColumn("structure", indexed_structure(F.col("heading_path"), F.split("heading_path", " > ")[0])).withColumn("content", _headed("structure"))
    return _once(spark, sf_dir, "structured", lambda: keyword_index.build(rows, keyword.surfaces(g.documents(spark, sf_dir))))


def _headed(path: str):
    return F.concat_ws(" ", path, "content")


def vectors(spark, sf_dir: str) -> vector_index.VectorIndex:
    return _once(spark, sf_dir, "vectors", lambda: vector_index.build(g.table(spark, sf_dir, "embeddings"), DIM))


def passage_vectors(spark, sf_dir: str) -> vector_index.VectorIndex:
    return _once(spark, sf_dir, "passage vectors", lambda: vector_index.build(g.vectors(spark, sf_dir).where("not is_surface"), DIM))


def surface_vectors(spark, sf_dir: str) -> vector_index.VectorIndex:
    return _once(spark, sf_dir, "surface vectors", lambda: vector_index.build(g.vectors(spark, sf_dir).where("is_surface and authored"), DIM))
