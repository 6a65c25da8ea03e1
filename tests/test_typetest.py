"""Permutation tests of all types at once against plain sums over the same hash ranks."""

import hashlib
import math
import random

import pytest

from axonframe.operators import compare, typetest
from axonframe.operators.graph import build_graph
from axonframe.schema import conform_edges, conform_neurons

TYPES = ["T1", "T2", "T3", "lonely", "hub"]


def _graph(spark, seed):
    rng = random.Random(seed)
    nodes, edges = [], {}
    for i in range(90):
        t = TYPES[i % 5] if i < 60 else ("hub" if i < 85 else None)
        if t == "lonely" and seed == 2:
            t = "T1"
        nodes.append(("d", str(seed), i, t, rng.choice(["left", "right"]) if i % 11 else "center"))
    for _ in range(700):
        edges[rng.randrange(90), rng.randrange(90)] = rng.randint(1, 30)
    n = conform_neurons(spark.createDataFrame(nodes, "dataset string, version string, neuron_id long, cell_type string, side string"))
    e = conform_edges(spark.createDataFrame([("d", str(seed), a, b, w) for (a, b), w in edges.items()], "dataset string, version string, pre long, post long, weight int"))
    return build_graph(n, e), {x[2]: x[3:] for x in nodes}, edges


def _brute(tables, ta, tb, n_perm, seed):
    """Observed and null statistics of one pair from dictionaries."""
    people = []
    for ds, t, (_, nodes, edges) in zip("ab", (ta, tb), tables, strict=True):
        for i, (kind, side) in nodes.items():
            if kind == t and side in ("left", "right"):
                share = {}
                for (pre, post), w in edges.items():
                    if pre == i and nodes[post][0]:
                        share[nodes[post][0]] = share.get(nodes[post][0], 0) + w
                people.append((ds, i, side, {k: v / sum(share.values()) for k, v in share.items()}))

    def mean(rows):
        return {x: sum(r.get(x, 0) for r in rows) / len(rows) for x in {x for r in rows for x in r}} if rows else None

    def apart(u, v):
        q = math.sqrt(sum(x * x for x in u.values())) * math.sqrt(sum(x * x for x in v.values()))
        return 1 - (sum(u[x] * v.get(x, 0) for x in u) / q if q else 0)

    def statistic(flags):
        of = lambda ds, sides: [p[3] for p, f in zip(people, flags, strict=True) if f == ds and p[2] in sides]
        both = ("left", "right")
        if not of("a", both) or not of("b", both):
            return None
        within = [apart(mean(of(ds, "left")), mean(of(ds, "right"))) for ds in "ab" if of(ds, ["left"]) and of(ds, ["right"])]
        return apart(mean(of("a", both)), mean(of("b", both))) - (sum(within) / len(within) if within else 0)

    nulls = []
    for k in range(1, n_perm + 1):
        flags = {}
        for side in ("left", "right"):
            mine = [p for p in people if p[2] == side]
            order = sorted(mine, key=lambda p: (hashlib.md5(f"{seed}:{k}:{p[0]}:{p[1]}".encode()).hexdigest()[:8], p[0], p[1]))
            for r, p in enumerate(order):
                flags[p[0], p[1]] = "a" if r < sum(x[0] == "a" for x in mine) else "b"
        nulls.append(statistic([flags[p[0], p[1]] for p in people]))
    return statistic([p[0] for p in people]), nulls


def test_all_types_equal_brute_force(spark):
    tables = [_graph(spark, 1), _graph(spark, 2)]
    pairs = spark.createDataFrame([("T1", "T1"), ("T1", "T1"), ("T2", "T1"), ("hub", "hub"), ("T3", "T3"), ("lonely", "lonely"), (None, "T1"), ("T2", "none")], "type_a string, type_b string")
    n = 30
    got = {(r["type_a"], r["type_b"]): r for r in typetest.compare_types(tables[0][0], tables[1][0], pairs, n_permutations=n, seed=7).collect()}
    assert len(got) == 7
    for (ta, tb), r in got.items():
        want, nulls = _brute(tables, ta, tb, n, 7) if ta else (None, [])
        if want is None:
            assert r["statistic"] is None and r["p"] is None and r["verdict"] is None
            continue
        mean = sum(nulls) / n
        sd = math.sqrt(sum((x - mean) ** 2 for x in nulls) / (n - 1))
        assert r["statistic"] == pytest.approx(want, abs=1e-9)
        assert r["p"] == pytest.approx((1 + sum(x >= want - 1e-9 for x in nulls)) / (n + 1))
        assert r["z"] == pytest.approx((want - mean) / sd, abs=1e-6)
    one = compare.type_statistic(compare.type_rows(tables[0][0], "hub"), compare.type_rows(tables[1][0], "hub")).first()
    assert [got["hub", "hub"][c] for c in ("statistic", "between", "within")] == pytest.approx([one[c] for c in ("statistic", "between", "within")])
    assert got["lonely", "lonely"]["n_b"] == 0 and got["T2", "none"]["n_b"] == 0 and got[None, "T1"]["n_a"] == 0


def test_same_data_differ_in_nothing(spark):
    g, _, _ = _graph(spark, 1)
    pairs = spark.createDataFrame([("hub", "hub")], "type_a string, type_b string")
    r = typetest.compare_types(g, g, pairs, n_permutations=9).first()
    assert r["between"] == pytest.approx(0) and r["p"] > 0.5 and r["verdict"] == "not distinguishable"
    assert typetest.compare_types(g, g, pairs.limit(0), n_permutations=9).count() == 0
    with pytest.raises(ValueError, match="n_permutations"):
        typetest.compare_types(g, g, pairs, n_permutations=0)
