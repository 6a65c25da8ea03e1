import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from axonframe.operators import calibrate as cal
from axonframe.operators.compare import fit_logistic

NAMES = ("s1", "margin")


@pytest.fixture(scope="module")
def records(spark):
    """(type, s1, margin, correct) of closed queries and (type, s1, margin) of open ones."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(600):
        s, m = rng.random(), rng.random()
        rows.append((f"T{i % 37}", float(s), float(m), bool(rng.random() < 1 / (1 + math.exp(-(4 * s + 3 * m - 3))))))
    opened = [(f"T{i % 37}", float(rng.random() * 0.7), float(rng.random()), False) for i in range(200)]
    make = lambda x: spark.createDataFrame(x, "type string, s1 double, margin double, correct boolean").withColumn("fold", cal.fold_of(F.col("type"), 4)).persist()
    return make(rows), make(opened)


def _frame(df):
    return df.orderBy("type", "s1").toPandas()


def test_models_of_all_folds_equal_single_fits(records):
    closed, _ = records
    d = _frame(closed)
    models = cal.fit_logistic_folds(closed, NAMES, "correct", F.col("fold"), n_folds=4)
    assert set(models) == {-1, 0, 1, 2, 3}
    for k, m in models.items():
        t = d[d.fold != k]
        want = fit_logistic(t[list(NAMES)].to_numpy(), t.correct.to_numpy(float), features=NAMES)
        assert m.coef == pytest.approx(want.coef, abs=1e-6) and m.intercept == pytest.approx(want.intercept, abs=1e-6)
    p = cal.out_of_fold(closed, models, F.col("fold")).orderBy("type", "s1").toPandas().p
    want = [1 / (1 + math.exp(-(models[r.fold].coef[0] * r.s1 + models[r.fold].coef[1] * r.margin + models[r.fold].intercept))) for r in d.itertuples()]
    assert np.allclose(p, want)


def test_separable_one_sided_and_null_rows(spark):
    rows = spark.createDataFrame([(float(i), i >= 5, 0) for i in range(10)] + [(None, True, 0), (1.0, None, 0)], "x double, y boolean, f int")
    (m,) = cal.fit_logistic_folds(rows, ("x",), "y").values()
    want = fit_logistic(np.arange(10.0)[:, None], np.arange(10) >= 5, features=("x",))
    assert m.coef[0] == pytest.approx(want.coef[0], rel=1e-3) and m.coef[0] > 1
    assert cal.fit_logistic_folds(rows.where("y"), ("x",), "y") == {}
    assert cal.fit_logistic_folds(rows.limit(0), ("x",), "y") == {}


def test_thresholds_and_report(records):
    closed, opened = records
    c, o = _frame(closed), _frame(opened)
    got = {r["fold"]: r for r in cal.out_of_fold_thresholds(closed, opened, n_folds=4).collect()}
    edge = np.minimum((c.margin * 20).astype(int), 19)
    for k in range(4):
        assert got[k]["s_floor"] == pytest.approx(np.quantile(o[o.fold != k].s1, 0.9))
        t = c.fold != k
        low = [b for b in range(20) if (t & (edge == b)).sum() >= 10 and c[t & (edge == b)].correct.mean() < 0.5]
        assert got[k]["delta"] == pytest.approx((max(low) + 1) / 20 if low else 0.01)
    rows = {r["variant"]: r for r in cal.calibration_report(closed.drop("fold"), opened.drop("fold"), {"both": NAMES, "score": ("s1",)}, n_folds=4).collect()}
    models = cal.fit_logistic_folds(closed, NAMES, "correct", F.col("fold"), n_folds=4)
    predict = lambda d: np.array([1 / (1 + math.exp(-(models[r.fold].coef[0] * r.s1 + models[r.fold].coef[1] * r.margin + models[r.fold].intercept))) for r in d.itertuples()])
    p, q = predict(c), predict(o)
    taken = (p >= 0.8) & (c.s1 >= c.fold.map(lambda k: got[k]["s_floor"]))
    false = (q >= 0.8) & (o.s1 >= o.fold.map(lambda k: got[k]["s_floor"]))
    r, b = rows["both"], np.minimum((p * 10).astype(int), 9)
    assert r["n"] == 600 and r["brier_oof"] == pytest.approx(((p - c.correct) ** 2).mean())
    assert r["ece_oof"] == pytest.approx(sum(abs(p[b == k].mean() - c.correct[b == k].mean()) * (b == k).mean() for k in np.unique(b)))
    assert (r["coverage"], r["accuracy_covered"], r["false_accept_open"]) == pytest.approx((taken.mean(), c.correct[taken].mean(), false.mean()))
    assert rows["score"]["brier_oof"] > r["brier_oof"]


def test_bootstrap(spark):
    rng = np.random.default_rng(4)
    rows = [(("a", "b", None)[i % 3], i % 50, float(rng.normal() + i % 50 / 25)) for i in range(3000)] + [("a", 1, None)]
    df = spark.createDataFrame(rows, "g string, u long, v double")
    got = {r["g"]: r for r in cal.bootstrap_means(df, "u", "v", by=["g"], n_boot=400).collect()}
    assert set(got) == {"a", "b", None}
    (all_,) = cal.bootstrap_means(df, "u", "v", n_boot=400).collect()
    values = np.array([r[2] for r in rows if r[2] is not None])
    units = np.array([r[1] for r in rows if r[2] is not None])
    assert all_["mean"] == pytest.approx(values.mean()) and (all_["n_units"], all_["n"]) == (50, 3000)
    sums = np.bincount(units, values)
    draws = np.random.default_rng(0).multinomial(50, [1 / 50] * 50, 4000)
    low, high = np.percentile(draws @ sums / (draws @ np.bincount(units)), [2.5, 97.5])
    assert all_["ci_low"] == pytest.approx(low, abs=0.05) and all_["ci_high"] == pytest.approx(high, abs=0.05)
    u = spark.range(20_000).select(cal.poisson_weight(cal.hash_uniform(F.lit(1), F.col("id"))).alias("w")).toPandas().w
    assert abs(u.mean() - 1) < 0.03 and abs(u.var() - 1) < 0.05
    assert cal.bootstrap_means(df.limit(0), "u", "v", by=["g"]).count() == 0


def test_a_draw_is_hashed_once_per_unit(spark):
    """Not once per group of the unit, nor again for every comparison with the cumulative odds."""
    rows = spark.createDataFrame([(g, u, float(u)) for u in range(4) for g in "abc"], "g string, u long, v double")
    found = cal.bootstrap_means(rows, "u", "v", by=["g"], n_boot=5)
    optimized = found._jdf.queryExecution().optimizedPlan().toString()
    assert optimized.count("md5(") == 1
