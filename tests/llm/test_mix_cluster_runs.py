"""Mixing, clustering and run detection against plain versions."""

import random

import brute
import duckdb
import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from corvane.llm import apportion, ball_tree, run_detection
from corvane.llm import queries as llm

SF = f"{DATA}/sf0.001"
ODD = brute.odd_rows()
VECTORS = "vec_id long, embedding array<double>, cluster string, v string, n long, part string"


def sources_of(rows):
    """The odd rows with sources: one of a single short row, one without words, one without a name."""
    return [(i, t, [None, "b", "a", "é", "Z"][k % 5] if (t or "").strip() else "empty", None, None, *[None] * len(brute.CLASHES.split(", "))) for k, (i, t) in enumerate(rows)]


def mixture(spark, rows):
    return spark.createDataFrame(sources_of(rows), f"doc_id long, text string, source string, n_chars long, target string, {brute.CLASHES}")


def hold(rows, share=1.5):
    """What any mix must keep: targets as dealt out plainly, words taken near them, at most twice a document."""
    size = {}
    for r in rows:
        size[r["source"]] = size.get(r["source"], 0) + r["size"]
    want = brute.source_targets(size, share=share)
    taken = dict.fromkeys(size, 0)
    for r in rows:
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        assert r["taken"] == r["whole"] * r["size"] + sum(p["words"] for p in r["parts"])
        assert all(0 <= p["start"] and p["words"] > 0 and p["start"] + p["words"] <= r["size"] for p in r["parts"])
        taken[r["source"]] += r["taken"]
    for s in size:
        assert abs(taken[s] - want[s]) <= 0.5


@pytest.mark.parametrize(("block", "shard"), [(256, 1 << 18), (7, 50), (1, 1), (1000, 20_000)])
def test_mix(spark, block, shard):
    docs = mixture(spark, ODD)
    found = apportion.mix(docs.repartition(3), block=block, shard_words=shard).collect()
    assert sorted(r["size"] for r in found) == sorted(len(brute.spaced(t)) for _, t in ODD)
    hold(found)
    again = apportion.mix(docs.repartition(5, "text"), block=block, shard_words=shard).collect()
    assert brute.in_order((r["doc_id"], r["size"], r["taken"]) for r in found) == brute.in_order((r["doc_id"], r["size"], r["taken"]) for r in again)


def test_mix_of_nothing(spark):
    assert apportion.mix(mixture(spark, [])).count() == 0
    assert [r["taken"] for r in apportion.mix(mixture(spark, [(1, None), (2, " ")])).collect()] == [0, 0]


def test_mix_of_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    hold(apportion.mix(docs, shard_words=5_000).collect())
    assert llm.op11_sainte_lague_mix(spark, SF).count() == docs.count()


@pytest.mark.parametrize("seed", range(6))
def test_seats(spark, seed):
    """The compared quotients give what dealing seat by seat gives, ties and hot parties included."""
    rng = random.Random(seed)
    parties, want = [], []
    for g in range(12):
        weights = [float(rng.choice([0, 1, 1, 3, 10, rng.randrange(1, 5_000), 100_000])) for _ in range(rng.randrange(1, 12))]
        house = rng.choice([0, 1, 2, 7, 100, 991]) if any(weights) else 0
        parties += [(g, k, w, house) for k, w in enumerate(weights)]
        want += [(g, k, n) for k, n in enumerate(brute.apportioned(weights, house))]
    df = spark.createDataFrame(parties, "g int, k int, w double, house long")
    assert brute.collected(apportion.sainte_lague(df, ["g"], "k", "w", F.col("house")), "g", "k", "seats") == want


CLUSTERED = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, None, None, None, None) for i, v in rows], VECTORS)


def cloud(seed, n, spread=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, 64))
    return [(int(i), (centres[i % 5] + spread * rng.normal(size=64)).tolist()) for i in range(n)]


@pytest.mark.parametrize("spread", [0.001, 0.3])
def test_clusters(spark, spread):
    rows = cloud(1, 300, spread)
    rows += [(None, rows[0][1]), (None, rows[1][1]), (7, rows[7][1]), (7, rows[7][1]), (8, rows[3][1]), (900, None), (901, []), (902, [0.5] * 63), (903, [None] + [0.5] * 63)]
    rows += [(904, [float("nan")] + [0.5] * 63), (905, [float("-inf")] + [0.5] * 63), (906, [-0.0] * 64), (907, [-0.0001] * 64)]
    assert brute.collected(ball_tree.cluster(vectors(spark, rows).repartition(3), tree=70), *CLUSTERED) == brute.lloyd(rows)


def test_few_equal_and_no_vectors(spark):
    few = [(1, [0.25] * 64), (2, [0.25] * 64), (3, [-3.0] * 64)]
    assert brute.collected(ball_tree.cluster(vectors(spark, few)), *CLUSTERED) == brute.lloyd(few)
    same = [(k, [0.125] * 64) for k in range(100)]
    assert brute.collected(ball_tree.cluster(vectors(spark, same)), *CLUSTERED) == brute.lloyd(same)
    assert ball_tree.cluster(vectors(spark, [])).count() == 0
    assert ball_tree.cluster(vectors(spark, [(1, None)])).count() == 0


def test_large_components(spark):
    """Beyond what float64 holds exactly, distances are still exact."""
    rng = random.Random(3)
    rows = [(k, [rng.choice([-1, 1]) * (30_000 + rng.random()) if k % 3 else rng.random() for _ in range(64)]) for k in range(40)]
    assert brute.collected(ball_tree.cluster(vectors(spark, rows), tree=16), *CLUSTERED) == brute.lloyd(rows)
    huge = ball_tree.cluster(vectors(spark, [(k, [3e38 * (-1) ** k] * 64) for k in range(12)])).collect()
    assert len(huge) == 12 and all(r["distance"] >= 0 for r in huge)


def test_balls_are_assigned_whole():
    """Where clusters stand apart, few leaves are compared."""
    points = np.array([[int(1024 * x) for x in v] for _, v in cloud(2, 2_000, 0.001)])
    tree, _ = ball_tree.Tree.build(points)
    whole, owners, leaves = tree.filter(points[:5])
    assert tree.counts[leaves].sum() < 200 and tree.counts[whole].sum() + tree.counts[leaves].sum() == 2_000
    nearest = ((tree.points[:, None, :] - points[:5]) ** 2).sum(2).argmin(1)
    assert (tree.assign(points[:5])[0] == nearest).all()


RUNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_runs_of_the_tables(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    assert brute.collected(llm.op13_harmonic_runs(spark, SF), *RUNS) == brute.run_digests(rows)


def test_runs_of_odd_rows(spark):
    # The long text of the odd rows has 30,000 words; its plain version takes too long, a shorter one stands in.
    rows = [(i, t if len(t or "") < 10_000 else " ".join(t.split()[:1_500] * 5)) for i, t in ODD]
    rows += [(k, " ".join(brute.PROSE[:k] * 9)) for k in range(1, 12)] + [(20, "x " * 700), (21, "a b " * 2 + "a b"), (22, "x x x x x"), (23, "x x x x x x"), (24, "a b a b a b a b"), (25, "X x X x X x X x")]
    docs = brute.documents(spark, rows).repartition(2)
    assert brute.collected(run_detection.detect(docs, run_detection.repeat_tail), *RUNS) == brute.run_digests(rows)
    assert brute.collected(run_detection.detect(docs), *RUNS) == brute.run_digests(rows, rewrite=False)
    assert run_detection.detect(brute.documents(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(30))
def test_runs_of_small_alphabets(seed):
    """Sequences full of runs within runs."""
    rng = random.Random(seed)
    seqs = []
    for _ in range(40):
        part = [rng.randrange(rng.choice([1, 2, 3])) for _ in range(rng.randrange(0, 30))]
        seqs.append(np.array([x for _ in range(rng.randrange(1, 7)) for x in part + [rng.randrange(3)] * rng.randrange(0, 8)], np.int64))
    for got, s in zip(run_detection.runs(seqs), seqs):
        assert [tuple(r) for r in got.tolist()] == brute.all_runs(s.tolist())
    for got, s in zip(run_detection.runs(seqs, least=2, periods=2), seqs):
        assert [tuple(r) for r in got.tolist()] == brute.all_runs(s.tolist(), 2, 2)
