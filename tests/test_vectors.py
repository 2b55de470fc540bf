"""The vector index against a search through all rows."""

import numpy as np
import pyarrow as pa
import pytest

from corvane.operators import search, vector_index

DIM = 8


def cloud(n, seed=1, groups=12, spread=0.2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, DIM))
    return [(int(k), (centres[k % groups] + spread * rng.normal(size=DIM)).tolist()) for k in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def nearest(rows, queries, k):
    kept = [(i, np.array(v)) for i, v in rows if i is not None and v is not None and len(v) == DIM and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    ids, m = np.array([i for i, _ in kept]), np.stack([v / np.linalg.norm(v) for _, v in kept])
    out = []
    for i, q in queries:
        score = np.round(m @ (np.array(q) / np.linalg.norm(q)), 6)
        out += [(i, rank + 1, int(ids[j]), float(score[j])) for rank, j in enumerate(np.lexsort((ids, -score))[:k])]
    return sorted(out)


ODD = [(1001, None), (1002, [0.0] * DIM), (1003, [1.0] * (DIM - 1)), (1004, [None] + [1.0] * (DIM - 1)), (1005, [float("nan")] * DIM), (1006, [float("inf")] * DIM), (None, [1.0] * DIM)]


@pytest.mark.parametrize(("spread", "lists"), [(0.05, 12), (1.0, 20), (0.2, 1)])
def test_exact_way(spark, spread, lists):
    rows = cloud(600, spread=spread)
    rows += [(2000 + k, rows[5][1]) for k in range(40)]  # copies: ties by id
    index = vector_index.build(frame(spark, rows + ODD).repartition(3), DIM, lists)
    queries = [r for r in rows if r[0] % 50 == 0]
    found = vector_index.search(index, frame(spark, queries), 7, probes=2, exact=True).collect()
    got, want = sorted(tuple(r) for r in found), nearest(rows, queries, 7)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert np.allclose([r[3] for r in got], [r[3] for r in want], atol=2e-6)


def test_large_list_is_many_blocks(spark, monkeypatch):
    """One list may hold most rows: its blocks stay bounded and nothing is lost."""
    rows = [(k, [1.0, *(0.001 * ((k * j) % 7) for j in range(1, DIM))]) for k in range(3_000)]
    index = vector_index.build(frame(spark, rows), DIM, 4)
    assert index.blocks.selectExpr("max(size(ids))", "sum(size(ids))").first()[:] == (vector_index.BLOCK, 3_000)
    found = vector_index.search(index, frame(spark, rows[:3]), 5, probes=1, exact=True).collect()
    assert [tuple(r)[:3] for r in sorted(found)] == [r[:3] for r in nearest(rows, rows[:3], 5)]


def test_probes_reach_the_recall_asked_for(spark):
    rows = cloud(2_000, spread=0.6)
    index = vector_index.build(frame(spark, rows), DIM, 30)
    queries = frame(spark, [r for r in rows if r[0] % 20 == 0])
    probes = vector_index.probes_for(index, queries, 10, 0.95)
    share = vector_index.recall(vector_index.search(index, queries, 10, probes), vector_index.search(index, queries, 10, exact=True)).agg({"recall": "avg"}).first()[0]
    assert probes < 30 and share >= 0.94


def test_nothing_to_search(spark):
    index = vector_index.build(frame(spark, ODD), DIM)
    assert vector_index.search(index, frame(spark, cloud(3)), 5, exact=True).count() == 0
    some = vector_index.build(frame(spark, cloud(5)), DIM)
    assert vector_index.search(some, frame(spark, ODD), 5, exact=True).count() == 0
    assert vector_index.search(some, frame(spark, cloud(1)), 50, exact=True).count() == 5


def test_two_arms(spark):
    """Documents by their nearest passage or authored surface, as the scan gives them."""
    rows = [(i, f"d{i % 40}", -1 if i % 5 == 0 else i // 40, i % 5 == 0, i % 10 == 0, v) for i, v in cloud(400)]
    vectors = spark.createDataFrame(rows, "vec_id long, document_id string, chunk_index int, is_surface boolean, authored boolean, embedding array<double>")
    arms = [vector_index.build(vectors.where(w), DIM) for w in ("not is_surface", "is_surface and authored")]
    for query in ([1.0] * DIM, rows[7][-1]):
        want = sorted(map(tuple, search.vector_search(vectors, query, 12, 30).collect()))
        assert sorted(map(tuple, search.vector_hits(*arms, vectors, query, 12, 30, probes=1).collect())) == want


def test_sample_is_that_of_smallest_hashes(spark):
    """A cut by a limit on hashes first, not by every task's own first rows."""
    rows = vector_index.directed(frame(spark, cloud(3_000)).repartition(7), DIM)
    want = [r["v"] for r in rows.selectExpr("v", "xxhash64(vec_id, v) h", "vec_id").orderBy("h", "vec_id").limit(50).collect()]
    assert np.allclose(vector_index._sampled(rows, 3_000, DIM, 50), [np.array(v) / np.linalg.norm(v) for v in want])
    # A share that turns out too small grows; a sample larger than the table is the table.
    assert len(vector_index._sampled(rows, 300_000, DIM, 50)) == 50 and len(vector_index._sampled(rows, 3_000, DIM, 5_000)) == 3_000


class _Taken:
    """Stands for a table and keeps the function that would run over it."""

    def mapInArrow(self, run, schema):
        self.run = run
        return self


@pytest.mark.parametrize("deal", [vector_index._probes, vector_index._others])
def test_queries_are_dealt_to_lists_in_small_batches(deal):
    """Every query may ask every list: copies of its vector leave the task in bounded batches."""
    rng = np.random.default_rng(3)
    index = vector_index.VectorIndex(None, vector_index._units(rng.normal(size=(40, DIM))), np.full(40, 3.0))
    q = pa.ListArray.from_arrays(pa.array(np.arange(0, 1000 * DIM + 1, DIM), pa.int32()), pa.array(rng.normal(size=1000 * DIM)))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(1000)), q, pa.array(np.full(1000, -2.0))], ["query_id", "q", "kth"])
    probes = 40 if deal is vector_index._probes else 0
    made = list(deal(index, _Taken(), probes).run(iter([batch])))
    assert max(b.num_rows for b in made) <= 40 * vector_index.DEALT
    assert sum(b.num_rows for b in made) == 40_000 and {tuple(r) for b in made for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist())} == {(i, j) for i in range(40) for j in range(1000)}
    assert all(b.column(2)[0].as_py() == q[b.column(1)[0].as_py()].as_py() for b in made)


def test_queries_go_once_to_each_part_and_are_not_broadcast(spark):
    """Rows made by Arrow batches look small to Spark; the queries of every list were once collected by the driver."""
    rows = [(k, [1.0, *(0.001 * ((k * j) % 7) for j in range(1, DIM))]) for k in range(3_000)] + [(3_000 + k, v) for k, v in cloud(400)]
    index = vector_index.build(frame(spark, rows), DIM, 12)
    first, spread = vector_index._parts(index, 4)
    assert index.sizes.sum() == 3_400 and spread.max() > 1 and len({*first[spread == 1].tolist()}) < (spread == 1).sum()
    queries = [r for r in rows if r[0] % 40 == 0]
    asked = vector_index.directed(frame(spark, queries), DIM).selectExpr("vec_id as query_id", "v as q")
    found = vector_index._scan(index, vector_index._probes(index, asked, 12), 5)
    per = {tuple(r) for r in found.groupBy("query_id").count().select("count").distinct().collect()}
    assert per == {(5 * int((first + spread).max()),)}
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    order = sorted((r["query_id"], -r["score"], r["vec_id"]) for r in found.collect())
    best = [r for k, r in enumerate(order) if k < 5 or order[k - 5][0] != r[0]]
    assert [(q, v) for q, _, v in best] == [(q, v) for q, _, v, _ in nearest(rows, queries, 5)]


def test_recall_broadcasts_no_queries(spark):
    """Probes, the exact way and the recall of the one against the other, over more queries than a batch takes."""
    rows = cloud(1_500, spread=1.0)
    index = vector_index.build(frame(spark, rows), DIM, 15)
    some = vector_index.search(index, frame(spark, rows[:700]), 10, probes=3)
    truth = vector_index.search(index, frame(spark, rows[:700]), 10, exact=True)
    want = {i: set() for i, _ in rows[:700]}
    for q, _, v, _ in nearest(rows, rows[:700], 10):
        want[q].add(v)
    got = {i: set() for i in want}
    for r in some.collect():
        got[r["query_id"]].add(r["vec_id"])
    assert {r["query_id"]: round(r["recall"], 6) for r in vector_index.recall(some, truth).collect()} == {i: round(len(want[i] & got[i]) / 10, 6) for i in want}
    for found in (some, truth):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow best" not in plan and plan.count("RepartitionByExpression") >= 1 and "query_unit" not in plan
