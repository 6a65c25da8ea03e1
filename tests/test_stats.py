import itertools
import math
import random

import numpy as np
import pytest

from axonframe.operators import stats as s


def test_rank_tests_against_enumeration():
    rng = random.Random(0)
    for _ in range(15):
        a, b = [rng.random() for _ in range(4)], [rng.random() + 0.3 for _ in range(3)]
        both = a + b
        u = lambda idx: sum(both[i] > both[j] for i in idx for j in range(7) if j not in idx)
        us = [u(c) for c in itertools.combinations(range(7), 4)]
        got = u(range(4))
        big = max(got, 12 - got)
        assert s.mann_whitney(np.array(a), np.array(b)) == pytest.approx(min(1, 2 * sum(x >= big for x in us) / len(us)))
        x, y = np.array(a), np.array([rng.random() for _ in range(4)])
        d = x - y
        r = s.average_ranks(np.abs(d))
        w = min(r[d > 0].sum(), r[d < 0].sum())
        ws = [sum(r[i] for i in range(4) if m >> i & 1) for m in range(16)]
        assert s.wilcoxon(x, y) == pytest.approx(min(1, 2 * sum(v <= w for v in ws) / 16))
    assert s.mann_whitney(np.ones(3), np.ones(4)) == 1 and s.mann_whitney(np.ones(3), np.zeros(4)) == 0
    assert s.wilcoxon(np.ones(3), np.ones(3)) == 1
    with pytest.raises(ValueError):
        s.wilcoxon(np.ones(3), np.ones(4))


def test_effect_size_and_groups():
    assert s.cohens_d(np.ones(3), np.zeros(3)) == 10 and s.cohens_d(np.ones(3), np.ones(3)) == 0
    r = s.compare_groups([1, 2, 3], [1, 2, 3])
    assert r["difference"] == 0 and r["ci_low"] <= 0 <= r["ci_high"] and r["p_value"] == 1


def test_bh(spark):
    p = [0.01, 0.04, 0.03, 0.5]
    got = {r["i"]: r["q_value"] for r in s.bh_qvalues(spark.createDataFrame(list(enumerate(p)), "i int, p_value double")).collect()}
    order = sorted(range(4), key=lambda i: p[i])
    want, low = {}, 1.0
    for k in range(3, -1, -1):
        low = min(low, p[order[k]] * 4 / (k + 1))
        want[order[k]] = low
    assert got == {k: pytest.approx(v) for k, v in want.items()}


def test_score_hits(spark):
    rows = [("reference", "r", "a", "candidate", 2.0, 1.0, 3.0, 0.01), ("w", "1", "a", "candidate", 1.5, 1.0, 2.0, 0.1), ("w", "2", "a", "candidate", -1.5, -2.0, -1.0, 0.1), ("nt", "1", "a", "candidate", 2.0, 1.0, 3.0, 0.1), ("reference", "r", "b", "candidate", 1.0, 0.0, 2.0, 0.2)]
    got = s.score_hits(spark.createDataFrame(rows, "axis string, variant string, candidate string, role string, difference double, ci_low double, ci_high double, q_value double")).collect()
    assert [(r["candidate"], r["n_axes"], r["n_failed"], r["tier"]) for r in got] == [("a", 2, 1, "Conditional")]


def test_null_p(spark):
    e = spark.createDataFrame([("x", 2.0), ("y", -1.0)], "k string, difference double")
    n = spark.createDataFrame([("x", 1.0), ("x", 3.0), ("x", math.nan), ("y", -2.0), ("y", 5.0)], "k string, null_difference double")
    assert {r["k"]: r["null_p"] for r in s.null_p_values(e, n, ["k"]).collect()} == {"x": pytest.approx(2 / 3), "y": pytest.approx(2 / 3)}
