"""Connected components against union-find."""

import random

import numpy as np
import pyarrow as pa

from corvane.operators import components
from corvane.operators.components import connected_components, joined_components


def plain(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {x: find(x) for x in up}


def labelled(rows):
    found = [tuple(r) for r in rows.collect()]
    assert len(found) == len(dict(found))
    return dict(found)


def test_components_and_later_links(spark):
    frame = lambda edges: spark.createDataFrame(edges, "a long, b long")
    r = random.Random(5)
    chain, star = [(k, k + 1) for k in range(1000, 1040)], [(2000, 2000 + k) for k in range(1, 40)]
    cases = [[], [(1, 2)], chain, star, [(2039 - a + 2000, 2039 - b + 2000) for a, b in star], [(r.randint(0, 150), r.randint(0, 150)) for _ in range(90)], chain + star + [(1040, 2000), (1, 2), (2, 1)]]
    for edges in cases:
        edges = [(a, b) for a, b in edges if a != b]
        labels = connected_components(frame(edges), "a", "b")
        assert labelled(labels) == plain(edges)
        for few in (0, 1_000):
            links = [(a, b) for a, b in ((r.randint(0, 200), r.choice([1000, 1020, 2003, 3000, 5, 6])) for _ in range(12)) if a != b]
            assert labelled(joined_components(labels, frame(links), "a", "b", few)) == plain(edges + links)


def test_labels_do_not_carry_the_rounds_before(spark):
    frame = lambda edges: spark.createDataFrame(edges, "a long, b long")
    edges = [(k, k + 1) for k in range(0, 90, 3)]
    labels = connected_components(frame(edges), "a", "b")
    for gap in (3, 6, 12):
        links = [(k, k + gap) for k in range(0, 80, 2 * gap)]
        edges += links
        labels = joined_components(labels, frame(links), "a", "b")
        # One scan of a written table, however many rounds came before.
        assert labels._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1
    assert labelled(labels) == plain(edges)


def test_edges_of_one_task_need_no_rounds(spark, monkeypatch):
    written = []
    once = components.materialize
    monkeypatch.setattr(components, "materialize", lambda df, name: written.append(name) or once(df, name))
    numbers = list(range(-200, 200))
    random.Random(1).shuffle(numbers)
    chain = list(zip(numbers, numbers[1:])) + [(k, k) for k in (7, 8)]
    assert labelled(connected_components(spark.createDataFrame(chain, "a long, b long").coalesce(1), "a", "b")) == plain(chain)
    assert len(written) == 1


def test_forest_in_pieces(monkeypatch):
    r = random.Random(2)
    for n in (0, 1, 5, 60, 400):
        edges = [(a, b) for a, b in ((r.randint(-n, n), r.randint(-n, n)) for _ in range(n)) if a > b]
        a, b = (np.array([e[k] for e in edges], np.int64) for k in (0, 1))
        want = {(x, c) for x, c in plain(edges).items() if x != c}
        assert set(zip(*(v.tolist() for v in components.forest(a, b)))) == want
        # Pieces keep what is connected.
        monkeypatch.setattr(components, "_HELD", 7)
        batches = [pa.record_batch([pa.array(a[k : k + 3]), pa.array(b[k : k + 3])], schema=components._EDGES) for k in range(0, len(a), 3)]
        left = [(x, y) for batch in components._forests(batches) for x, y in zip(*(c.to_pylist() for c in batch.columns))]
        assert plain(left) == plain(edges) and all(x > y for x, y in left)
