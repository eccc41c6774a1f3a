"""Graph operators against hand values and brute force over paths."""

import math
import random

import pandas as pd
import pytest

from specweave.operators import graph as g
from specweave.operators import ranking as r

SCHEMA = "doc string, source string, target string, w double, relation_type string, seq int"


def frame(spark, edges, doc="d"):
    return spark.createDataFrame([(doc, s, t, float(w), "ENABLES", i) for i, (s, t, w) in enumerate(edges)], SCHEMA)


def records(spark, edges):
    e = frame(spark, edges)
    return {(x["source"], x["target"]): x for x in g.ranking_records(g.paths(e, ["doc"]), e, ["doc"]).collect()}


def test_cycle_is_cut_at_its_weakest_edge(spark):
    kept, out = g.remove_cycles(frame(spark, [("A", "B", 0.9), ("B", "C", 0.8), ("C", "A", 0.5), ("A", "D", 0.95)]), ["doc"])
    assert [(x["source"], x["target"], x["reason"]) for x in out.collect()] == [("C", "A", "cycle_removal")]
    e = kept.collect()
    got = records(spark, [(x["source"], x["target"], x["w"]) for x in e])
    assert got["A", "D"]["dps"] == pytest.approx(0.95)
    assert got["A", "C"]["dps"] == pytest.approx(0.72)
    assert ("D", "A") not in got


def test_parent_limit(spark):
    kept, out = g.limit_parents(frame(spark, [(f"P{i}", "T", 0.5 + i / 100) for i in range(20)]), ["doc"], 3)
    assert sorted(x["source"] for x in kept.collect()) == ["P17", "P18", "P19"]
    assert out.count() == 17


def test_strongest_and_shortest_paths_differ(spark):
    x = records(spark, [("A", "B", 0.6), ("B", "D", 0.6), ("A", "C", 0.9), ("C", "E", 0.9), ("E", "D", 0.9)])["A", "D"]
    assert x["path"] == ["A", "B", "D"]
    assert x["strongest_support_path"] == ["A", "C", "E", "D"]
    assert x["extraction_support"] == pytest.approx(0.9)
    assert x["dps"] == pytest.approx(0.5445)


def test_ties_take_the_lesser_path(spark):
    x = records(spark, [("A", "C", 0.8), ("C", "D", 0.8), ("A", "B", 0.8), ("B", "D", 0.8)])["A", "D"]
    assert x["path"] == ["A", "B", "D"] == x["strongest_support_path"]


def test_a_cycle_is_refused(spark):
    with pytest.raises(ValueError, match="cycle"):
        g.paths(frame(spark, [("A", "B", 0.5), ("B", "A", 0.5)]), ["doc"])


def test_empty_graph(spark):
    e = frame(spark, [])
    assert g.ranking_records(g.paths(e, ["doc"]), e, ["doc"]).count() == 0


def _brute(edges):
    out, parents = {}, {}
    for s, t, w in edges:
        out.setdefault(s, []).append((t, w))
        parents.setdefault(t, []).append((s, w))
    nodes = sorted({x for e in edges for x in e[:2]})

    def activation(node, clamp, value):
        if node == clamp:
            return value
        own = parents.get(node)
        return 1.0 if not own else sum(w * activation(p, clamp, value) for p, w in own) / len(own)

    def walks(s, t):
        if s == t:
            return [([s], 0.0)]
        return [([s, *p], math.log(w) + q) for n, w in out.get(s, []) for p, q in walks(n, t)]

    return {(s, t): (activation(t, s, 1.0) - activation(t, s, 0.0), max(math.exp(q / (len(p) - 1)) for p, q in all_), min((len(p), p) for p, _ in all_)[1]) for s in nodes for t in nodes if s != t and (all_ := walks(s, t))}


def test_random_graphs_match_brute_force(spark):
    rng = random.Random(3)
    graphs = {}
    for k in range(12):
        names = [f"N{i}" for i in range(6)]
        edges = [(names[i], names[j], rng.uniform(0.2, 1)) for i in range(6) for j in range(i + 1, 6) if rng.random() < 0.45]
        if edges:
            graphs[f"g{k}"] = edges
    e = None
    for k, edges in graphs.items():
        e = frame(spark, edges, k) if e is None else e.unionByName(frame(spark, edges, k))
    got = {(x["doc"], x["source"], x["target"]): x for x in g.ranking_records(g.paths(e, ["doc"]), e, ["doc"]).collect()}
    want = {(k, *st): v for k, edges in graphs.items() for st, v in _brute(edges).items()}
    assert got.keys() == want.keys()
    for key, (dps, support, path) in want.items():
        assert got[key]["dps"] == pytest.approx(dps, abs=1e-9)
        assert got[key]["extraction_support"] == pytest.approx(support, abs=1e-9)
        assert got[key]["path"] == path


def test_cycle_removal_always_ends_acyclic():
    rng = random.Random(5)
    for _ in range(50):
        names = [f"N{i}" for i in range(7)]
        edges = pd.DataFrame([(a, b, rng.random(), i) for i, (a, b) in enumerate((a, b) for a in names for b in names if a != b and rng.random() < 0.4)], columns=["source", "target", "w", "seq"])
        dropped = g.mark_cycles(edges)
        left = edges[dropped == 0]
        assert (g.mark_cycles(left) == 0).all()
        assert sorted(dropped[dropped > 0]) == list(range(1, int(dropped.max() or 0) + 1))


def test_ranking_strategies_and_budgets(spark):
    rows = [("d", "r1", "A", "B", 0.5, 0.9, 1), ("d", "r2", "A", "C", 0.5, 0.2, 2), ("d", "r3", "B", "C", 0.7, 0.9, 1)]
    pool = spark.createDataFrame(rows, "doc string, record_id string, source string, target string, dps double, extraction_support double, shortest_path_length int")
    order = lambda s, seed=0: [x["record_id"] for x in r.rank_records(pool, s, ["doc"], seed).orderBy("rank").collect()]
    assert order("dps") == ["r3", "r1", "r2"]
    assert order("extraction_support") == ["r1", "r3", "r2"]
    assert order("topology") == ["r1", "r3", "r2"]
    assert order("unranked") == ["r1", "r2", "r3"]
    assert order("random", 4) == order("random", 4)
    with pytest.raises(ValueError):
        r.rank_records(pool, "best", ["doc"])
    ranked = r.rank_records(pool, "dps", ["doc"])
    assert r.cut(ranked, 2).count() == 2
    assert {x["nominal_budget"]: x["count"] for x in r.budget_grid(ranked, [1, 2, 10]).groupBy("nominal_budget").count().collect()} == {1: 1, 2: 2, 10: 3}
