"""Nearest vectors for very many queries: through the index exactly, and how much of that probes find."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import vector_index
from ..sources import graph_tables as g
from . import _indexes


def _asked(spark, sf_dir):
    """Every vector whose id is divisible by 100 asks all vectors."""
    return g.table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0")


def q7_1_nearest(spark, sf_dir):
    """The ten nearest of each asked vector, exactly: the probes first, then the lists that could still hold a nearer one."""
    return vector_index.search(_indexes.vectors(spark, sf_dir), _asked(spark, sf_dir), exact=True)


def q7_1_recall(spark, sf_dir):
    """How many of the ten nearest the probes find that the index chooses for a recall of 0.95 over a sample of queries."""
    index, asked = _indexes.vectors(spark, sf_dir), _asked(spark, sf_dir)
    probes = vector_index.probes_for(index, asked)
    found = vector_index.search(index, asked, probes=probes)
    return vector_index.recall(found, vector_index.search(index, asked, exact=True)).withColumn("probes", F.lit(probes)).withColumn("lists", F.lit(len(index.centres)))


QUERIES = {n: f for n, f in list(globals().items()) if n.startswith("q") and callable(f)}

ORACLE = {
    "q7_1_nearest": """
        WITH v AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE len(list_filter(embedding, lambda e: e <> 0)) > 0),
        s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.x, v.x), 6) AS score FROM v, (SELECT * FROM v WHERE vec_id % 100 = 0) q)
        SELECT query_id, rank, vec_id, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s) WHERE rank <= 10""",
}
