"""Chain and purge order against plain walks, on forks, merges, cycles and a long chain."""

import random

import pytest

from corvane.operators import chain_order, graph

EDGE = "id string, source_id string, target_id string, edge_type string"


def tables(spark, docs, pairs, other=()):
    rows = [(f"e{k}", s, t, "supersedes") for k, (s, t) in enumerate(pairs)] + [(f"o{k}", s, t, kind) for k, (s, t, kind) in enumerate(other)]
    return spark.createDataFrame([(d, "ok", "h" + d) for d in docs], "id string, pipeline_status string, source_content_hash string"), spark.createDataFrame(rows, EDGE)


def component(docs, pairs, at):
    seen, todo = set(), [at]
    while todo:
        d = todo.pop()
        if d not in seen:
            seen.add(d)
            todo += [t for s, t in pairs if s == d] + [s for s, t in pairs if t == d]
    return seen


def plain_order(docs, pairs, asked):
    """The chain of a document, oldest first: a linear walk or breadth first from the roots, reversed."""
    pairs = {(s, t) for s, t in pairs if s != t and s in docs and t in docs}
    inside = component(docs, pairs, asked)
    older = {d: sorted(t for s, t in pairs if s == d) for d in inside}
    newer = {d: [s for s, t in pairs if t == d] for d in inside}
    roots = sorted(d for d in inside if not newer[d])
    queue, walk = roots or [asked], []
    for d in queue:
        if d not in walk:
            walk.append(d)
            queue += [t for t in older[d] if t not in walk]
    return walk[::-1], all(len(older[d]) <= 1 and len(newer[d]) <= 1 for d in inside), inside


def plain_purge(docs, pairs, head):
    pairs = {(s, t) for s, t in pairs if s != t}
    inside, out = component(docs, pairs, head), []

    def visit(d):
        if d not in out:
            out.append(d)
            for t in sorted(t for s, t in pairs if s == d):
                visit(t)

    visit(head)
    return out + sorted(inside - set(out))


SHAPES = {
    "line": [("d", "c"), ("c", "b"), ("b", "a")],
    "fork": [("d", "b"), ("d", "c"), ("c", "a"), ("b", "z")],
    "merge": [("d", "b"), ("c", "b"), ("b", "a"), ("d", "a")],
    "cycle": [("a", "b"), ("b", "c"), ("c", "a")],
    "led cycle": [("a", "b"), ("b", "c"), ("c", "b"), ("c", "d")],
    "knot": [("a", "b"), ("b", "c"), ("c", "a"), ("c", "b")],
    "alone": [], "self": [("a", "a"), ("b", "a")], "twice": [("b", "a"), ("b", "a"), ("b", "nowhere")],
}


def compare(spark, docs, pairs):
    other = [(d, d.replace("a-", "b-"), "references") for d in docs if d[:2] == "a-"]
    linked = {x for p in pairs for x in p} | {None}
    frame, edges = tables(spark, docs, pairs, other)
    got = {r["id"]: r for r in chain_order.chain_answers(frame, edges, frame).collect()}
    assert set(got) == set(docs)
    for d in docs:
        walk, linear, inside = plain_order(docs, pairs, d)
        r = got[d]
        assert (r["page"], r["total_length"], r["is_linear"]) == (walk, len(walk), linear), d
        assert (r["head_id"], r["tail_id"], r["query_position"]) == (walk[-1], walk[0], walk.index(d) if d in walk else 0), d
        kinds = {"references"} if d[0] in "ab" else set()
        assert r["available_edge_types"] == (None if len(walk) > 1 else sorted(kinds | ({"supersedes"} if d in linked else set()))), d
    return frame, edges


def test_shapes(spark):
    """All shapes at once, each with documents of its own."""
    docs, pairs = [], []
    for name, some in SHAPES.items():
        docs += [f"{d}-{name}" for d in sorted({d for p in some for d in p if d != "nowhere"} | {"a", "b", "q"})]
        pairs += [(f"{x}-{name}", f"{y}-{name}") for x, y in some]
    compare(spark, docs, pairs)


def test_a_page(spark):
    docs, pairs = list("abcdef"), [("f", "e"), ("e", "d"), ("d", "c"), ("c", "b"), ("b", "a")]
    frame, edges = tables(spark, docs, pairs)
    r = chain_order.chain_answers(frame, edges, frame.where("id = 'c'"), offset=2, limit=3).first()
    assert (r["page"], r["query_position"], r["total_length"]) == (["c", "d", "e"], 2, 6)


@pytest.mark.parametrize("seed", range(2))
def test_many_random_chains(spark, seed):
    rng = random.Random(seed)
    docs, pairs = [], []
    for c in range(12):
        own = [f"{chr(97 + c)}{k:02d}" for k in range(rng.randrange(1, 9))]
        docs += own
        pairs += [(rng.choice(own), rng.choice(own)) for _ in range(rng.randrange(0, 10))]
    frame, edges = tables(spark, docs, pairs)
    got = {r["id"]: r["page"] for r in chain_order.chain_answers(frame, edges, frame).collect()}
    for d in docs:
        assert got[d] == plain_order(docs, pairs, d)[0], (d, pairs)
    clean = {(s, t) for s, t in pairs if s != t}
    heads = [d for d in docs if not any(t == d for _, t in clean)]
    none = edges.where("false")
    rows = chain_order.purge_order(frame, edges, frame.where(frame.id.isin(heads)).selectExpr("id AS head_id"), none, ("ok",), allow_branched=True).collect()
    turns = {}
    for r in sorted(rows, key=lambda r: r["turn"]):
        assert r["refusal"] is None
        turns.setdefault(r["head_id"], []).append(r["id"])
    assert turns == {h: plain_purge(docs, pairs, h) for h in heads}


def test_purge_refusals(spark):
    docs = list("abcdefgh")
    frame, edges = tables(spark, docs, [("b", "a"), ("d", "c"), ("e", "c"), ("g", "f")])
    frame = frame.selectExpr("id", "CASE WHEN id = 'f' THEN 'running' ELSE pipeline_status END AS pipeline_status", "source_content_hash")
    staging = spark.createDataFrame([("s1", "a", "h", "references")], EDGE)
    heads = spark.createDataFrame([(x,) for x in ("a", "b", "d", "g", "h", "nobody")], "head_id string")
    rows = chain_order.purge_order(frame, edges, heads, staging, ("ok",)).collect()
    got = {(r["head_id"], r["id"]): (r["turn"], r["cause"], r["refusal"]) for r in rows}
    assert got == {
        ("a", None): (None, None, "not_head"), ("d", None): (None, None, "branched"), ("nobody", None): (None, None, "not_found"),
        ("b", "b"): (0, None, "members"), ("b", "a"): (1, "pending_staging_edge", "members"), ("g", "g"): (0, None, "members"), ("g", "f"): (1, "non_terminal_status", "members"), ("h", "h"): (0, "pending_staging_edge", "members"),
    }
    too_long = chain_order.purge_order(frame, edges, heads.where("head_id = 'd'"), staging, ("ok",), allow_branched=True, merged=1).collect()
    assert [(r["head_id"], r["id"], r["refusal"]) for r in too_long] == [("d", None, "too_branched")]


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    """A list of 100,000 is ranked in 17 doublings."""
    n, rounds = 100_000, []
    write = chain_order.materialize
    monkeypatch.setattr(chain_order, "materialize", lambda df, name: rounds.append(name) or write(df, name))
    items = spark.range(n).selectExpr("id", "CASE WHEN id < 99999 THEN id + 1 END AS next", "1 AS weight")
    got = chain_order.list_rank(items).selectExpr("min(rank + id)", "max(rank + id)", "count(*)").first()
    assert tuple(got) == (n, n, n) and len(rounds) <= 19


def test_nothing(spark):
    frame, edges = tables(spark, [], [("a", "b")])
    assert chain_order.chain_order(frame, edges).count() == 0 and chain_order.chain_answers(frame, edges, frame).count() == 0


def test_seeds_by_policy(spark):
    frame, edges = tables(spark, list("abcd"), [("b", "a"), ("c", "b")], [("a", "d", "references"), ("d", "b", "derived_from"), ("a", "d", "supersedes_not")])
    starts = frame.where("id = 'c'")
    seeds = lambda direction, kind=None: sorted(r["seed"] for r in graph.policy_seeds(frame, edges, starts, direction, kind).collect())
    assert seeds("outbound", "references") == seeds("inbound", "references") == seeds("outbound") == seeds("outbound", "derived_from") == ["a", "b", "c"]
    assert seeds("inbound", "derived_from") == seeds("outbound", "supersedes") == seeds("inbound", "unheard_of") == ["c"]
    with pytest.raises(ValueError):
        seeds("outbound", "sync_target")
    found = graph.seeded_traverse(frame, edges, frame.where("id in ('c', 'd')"), "both", row_cap=2).collect()
    assert {r["start_id"]: r["truncated"] for r in found} == {"c": True, "d": True} and all(r["depth"] == 1 for r in found)
    assert {(r["start_id"], r["id"], r["truncated"]) for r in graph.seeded_traverse(frame, edges, frame.where("id = 'c'"), "outbound", "references").collect()} == {("c", "o0", False)}


def test_no_table_of_an_answer_passes_through_the_driver(spark):
    """However small the tables of a round are, they are joined where they are dealt to (F17)."""
    docs = spark.createDataFrame([(f"d{k}",) for k in range(12)], "id string")
    edges = spark.createDataFrame([(f"d{k + 1}", f"d{k}", "supersedes") for k in range(9) if k != 4], "source_id string, target_id string, edge_type string")
    found = chain_order.chain_answers(docs, edges, docs, limit=2)
    assert {r["id"]: (r["query_position"], r["total_length"]) for r in found.collect()}["d3"] == (3, 5)
    assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()
