import itertools
import random

import pytest

from axonframe.operators import graph as g
from axonframe.operators import paths as p

NODES = [(1, "A", "acetylcholine", 10), (2, "B", "gaba", 20), (3, "C", "acetylcholine", 40), (4, "D", None, 10)]
EDGES = [(1, 2, 10), (2, 3, 8), (1, 3, 4), (2, 4, 5), (4, 3, 6), (3, 1, 2)]


def build(spark, nodes=NODES, edges=EDGES, **kw):
    n = spark.createDataFrame(nodes, "neuron_id long, cell_type string, nt_pred string, input_synapses_total long")
    return g.build_graph(n, spark.createDataFrame(edges, "pre long, post long, weight int"), **kw)


@pytest.fixture(scope="module")
def toy(spark):
    return build(spark)


def _rows(df):
    return {tuple(r["path"]): r for r in df.collect()}


def test_toy_paths(toy):
    r = _rows(p.find_paths(toy, [1], [3], label="cell_type"))
    assert set(r) == {(1, 3), (1, 2, 3), (1, 2, 4, 3)}
    assert r[1, 3]["strength"] == pytest.approx(0.1) and r[1, 2, 3]["strength"] == pytest.approx(0.1)
    assert [r[k]["path_sign"] for k in ((1, 3), (1, 2, 3), (1, 2, 4, 3))] == [1, -1, 0]
    assert r[1, 2, 3]["labels"] == ["A", "B", "C"] and r[1, 2, 4, 3]["min_weight"] == 5
    assert set(_rows(p.find_paths(toy, [1], [3], min_weight=5))) == {(1, 2, 3), (1, 2, 4, 3)}
    assert set(_rows(p.find_paths(toy, [1], [3], min_edge_fraction=0.16))) == {(1, 2, 3)}
    assert (1, 2, 4, 3) not in _rows(p.find_paths(toy, [1], [3], min_strength=0.05))
    assert len(_rows(p.find_paths(toy, [1], [3], max_paths=1))) == 1
    with pytest.raises(KeyError):
        p.find_paths(toy, [99], [3])
    with pytest.raises(ValueError):
        p.find_paths(toy, [1], [3], max_hops=0)


def test_nodes_on_paths(toy):
    ids = lambda **k: {r["neuron_id"] for r in p.nodes_on_paths(toy, [1], [3], **k).collect()}
    assert ids(max_hops=1) == {1, 3} and ids(max_hops=2) == {1, 2, 3} and ids(max_hops=3) == {1, 2, 3, 4}
    assert ids(max_hops=1, min_weight=5) == {1}


def test_effective(spark):
    nodes = [(1, "A", "acetylcholine", 10), (2, "B", "gaba", 10), (3, "C", "acetylcholine", 10)]
    t = build(spark, nodes, [(1, 2, 5), (2, 3, 10), (1, 3, 2)])
    got = {r["hops"]: r["value"] for r in p.effective_by_hops(t, [1], [3]).collect()}
    assert got == {1: pytest.approx(0.2), 2: pytest.approx(-0.5), 3: 0}
    two = {(r["pre"], r["post"]): r["value"] for r in p.effective_connectivity(t, 2, signed=False, threshold=0.3).collect()}
    assert two[1, 3] == pytest.approx(0.5)
    both = {(r["pre"], r["post"]): r["value"] for r in p.effective_connectivity(t, 2, cumulative=True).collect()}
    assert both[1, 3] == pytest.approx(-0.3)


def test_random_graph_against_brute_force(spark):
    rng = random.Random(4)
    edges = [(a, b, rng.randint(1, 29)) for a, b in itertools.permutations(range(1, 41), 2) if rng.random() < 0.08]
    nodes = [(i, f"T{i % 5}", rng.choice(["acetylcholine", "gaba", None]), None) for i in range(1, 41)]
    t = build(spark, nodes, edges)
    out, total = {}, {}
    for a, b, w in edges:
        out.setdefault(a, []).append((b, w))
        total[b] = total.get(b, 0) + w
    want = {}

    def walk(path, strength):
        if len(path) > 1 and path[-1] in (38, 39, 40):
            want[tuple(path)] = strength
            return
        if len(path) < 4:
            for b, w in out.get(path[-1], []):
                if b not in path and w >= 3:
                    walk([*path, b], strength * w / total[b])

    for s in (1, 2, 3):
        walk([s], 1.0)
    got = _rows(p.find_paths(t, [1, 2, 3], [38, 39, 40], min_weight=3))
    assert set(got) == set(want)
    assert all(got[k]["strength"] == pytest.approx(v) for k, v in want.items())
    label = {i: f"T{i % 5}" for i in range(1, 41)}
    sums = {}
    for a, b, w in edges:
        sums[label[a], label[b]] = sums.get((label[a], label[b]), 0) + w
    assert {(r["pre_label"], r["post_label"]): r["weight"] for r in g.aggregate(t, "cell_type").collect()} == sums


def test_signs_subset_and_totals(spark, toy):
    n = spark.createDataFrame([(1, "acetylcholine", 0.6, 0.4), (2, None, None, None)], "neuron_id long, nt_pred string, nt_p_acetylcholine float, nt_p_gaba float")
    for nt in g.NT_CLASSES:
        if f"nt_p_{nt}" not in n.columns:
            n = n.selectExpr("*", f"cast(0 as float) as nt_p_{nt}")
    sign = {r["neuron_id"]: r["s"] for r in n.select("neuron_id", g.sign_column(n, g.PROBABILISTIC).alias("s")).collect()}
    assert sign[1] == pytest.approx(0.2) and sign[2] == 0
    with pytest.raises(ValueError):
        g.sign_column(n, g.SAMPLED)
    sub = g.subset(toy, [1, 2, 3])
    assert {(r["pre"], r["post"]) for r in sub.edges.collect()} == {(1, 2), (2, 3), (1, 3), (3, 1)}
    assert g.counts(toy)["excluded_unknown_sign_neurons"] == 1
    assert {(r["pre"], r["post"]) for r in g.silence(toy.edges, [1]).collect()} == {(2, 3), (2, 4), (4, 3), (3, 1)}
