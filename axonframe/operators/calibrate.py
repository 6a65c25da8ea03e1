"""Resampling and logistic calibration as Spark aggregates: no table of records on the driver.

A bootstrap draw is a Poisson weight hashed from the resampled unit and the draw's number, so all draws are one
aggregation. A Newton step is one aggregate of gradient and Hessian; the fold is a column, so the models of all folds take a
step together, and only their coefficients are on the driver."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import hash_uniform
from .compare import LogisticModel

#: Poisson counts beyond this have odds below 1e-9.
MOST = 12


def poisson_weight(u: Column) -> Column:
    """A Poisson count of mean 1 from a uniform number, by the cumulative odds."""
    weight, total = F.lit(MOST), [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(MOST)]
    for k in reversed(range(MOST)):
        weight = F.when(u < total[k], k).otherwise(weight)
    return weight


def bootstrap_means(records: DataFrame, unit: str, value: str, *, by: Sequence[str] = (), n_boot: int = 1000, seed: int = 0, level: float = 0.95) -> DataFrame:
    """(by..., n_units, n, mean, ci_low, ci_high): the mean of ``value`` and its interval over draws of whole units.

    Records are summed per unit first, so that units times draws is all that grows with ``n_boot``; a draw is hashed once per unit, for
    all its groups. Draws without any record are left out; null values are no records."""
    part = records.where(F.col(value).isNotNull()).groupBy(*by, unit).agg(F.sum(F.col(value).cast("double")).alias("_s"), F.count("*").alias("_c"))
    whole = part.groupBy(*by).agg(F.count("*").alias("n_units"), F.sum("_c").alias("n"), (F.sum("_s") / F.sum("_c")).alias("mean"))
    units = part.groupBy(unit).agg(F.collect_list(F.struct(*by, "_s", "_c")).alias("_g"))  # an item per group that the unit is in
    draws = F.transform(F.sequence(F.lit(1), F.lit(n_boot)), lambda k: hash_uniform(F.lit(seed), F.col(unit), k))
    # The number is a column of its own: inside the weight it would be hashed again for every comparison.
    drawn = units.select("_g", F.posexplode(draws).alias("_draw", "_u")).withColumn("_w", poisson_weight(F.col("_u"))).where("_w > 0")
    drawn = drawn.select("_draw", "_w", F.inline("_g"))
    means = drawn.groupBy(*by, "_draw").agg((F.sum(F.col("_w") * F.col("_s")) / F.sum(F.col("_w") * F.col("_c"))).alias("_m"))
    tail = (1 - level) / 2
    cut = means.groupBy(*by).agg(F.percentile("_m", F.lit(tail)).alias("ci_low"), F.percentile("_m", F.lit(1 - tail)).alias("ci_high"))
    if not by:
        return whole.join(F.broadcast(cut))  # one row each
    names = [f"_k{i}" for i in range(len(by))]
    cut = cut.select(*(F.col(c).alias(k) for c, k in zip(by, names, strict=True)), "ci_low", "ci_high")
    same = F.lit(True)
    for c, k in zip(by, names, strict=True):
        same = same & F.col(c).eqNullSafe(F.col(k))
    return whole.join(cut, same, "left").drop(*names)


def fold_of(unit: Column, n_folds: int, seed: int = 0) -> Column:
    """The fold (from 0) of a unit, the same in every table."""
    return F.floor(hash_uniform(F.lit(seed), unit) * n_folds).cast("int")


def _sums(rows: DataFrame, features: Sequence[str], weights: Mapping[int, np.ndarray], label: str) -> dict[int, tuple[np.ndarray, np.ndarray, float, int, float]]:
    """Per model: gradient, Hessian, loss, rows and positives at its weights, over the rows it learns from."""
    d = len(features) + 1
    x = [*(F.col(f).cast("double") for f in features), F.lit(1.0)]
    table = rows.sparkSession.createDataFrame([(int(k), [float(v) for v in w]) for k, w in weights.items()], "_model int, _w array<double>")
    met = rows.withColumn("_model", F.explode(F.array(*map(F.lit, weights)))).where("_model <> _fold").join(F.broadcast(table), "_model")  # a row per model
    z = sum((x[i] * F.col("_w")[i] for i in range(1, d)), x[0] * F.col("_w")[0])
    met = met.withColumn("_z", z).withColumn("_p", 1 / (1 + F.exp(-F.col("_z")))).withColumn("_y", F.col(label).cast("double"))
    v = F.col("_p") * (1 - F.col("_p"))
    sums = [F.sum((F.col("_p") - F.col("_y")) * x[i]) for i in range(d)] + [F.sum(v * x[i] * x[j]) for i in range(d) for j in range(i + 1)]
    # log(1 + e^z) without overflow
    loss = F.sum(F.greatest("_z", F.lit(0.0)) + F.log1p(F.exp(-F.abs("_z"))) - F.col("_y") * F.col("_z"))
    out = {}
    for r in met.groupBy("_model").agg(F.array(*sums).alias("s"), loss.alias("loss"), F.count("*").alias("n"), F.sum("_y").alias("y")).collect():
        g, h = np.array(r["s"][:d]), np.zeros((d, d))
        h[np.tril_indices(d)] = r["s"][d:]
        out[r["_model"]] = g, h + np.tril(h, -1).T, r["loss"], r["n"], r["y"]
    return out


def fit_logistic_folds(rows: DataFrame, features: Sequence[str], label: str, fold: Column | None = None, *, n_folds: int = 1, l2: float = 1e-4, max_steps: int = 50, tolerance: float = 1e-9) -> dict[int, LogisticModel]:
    """Logistic models with L2 (not on the intercept): model k (from 0) learns from the rows of other folds than k, model -1 from all.

    ``rows`` is read once a step and should be settled. A step that does not lower a model's loss is halved, all models in
    the same pass. A model whose rows have one outcome alone is left out; rows with a null feature or label are not read."""
    known = rows.where(F.col(label).isNotNull())
    for f in features:
        known = known.where(F.col(f).isNotNull())
    known = known.select(*features, label, (fold if fold is not None else F.lit(0)).alias("_fold"))
    d = len(features) + 1
    ridge = np.full(d, l2)
    ridge[-1] = 0
    cost = lambda s, w: s[2] + 0.5 * float((ridge * w * w).sum())
    ids = [-1, *(range(n_folds) if fold is not None else ())]
    at = {k: np.zeros(d) for k in ids}
    here = {k: s for k, s in _sums(known, features, at, label).items() if 0 < s[4] < s[3]}
    move, size, done = {}, {}, set()
    for k, s in here.items():
        move[k], size[k] = np.linalg.lstsq(s[1] + np.diag(ridge + 1e-12), s[0] + ridge * at[k], rcond=None)[0], 1.0
    for _ in range(max_steps):
        tried = {k: at[k] - size[k] * move[k] for k in here if k not in done}
        if not tried:
            break
        for k, s in _sums(known, features, tried, label).items():
            if cost(s, tried[k]) > cost(here[k], at[k]) and size[k] > 1e-8:
                size[k] /= 2
                continue
            step = np.abs(size[k] * move[k]).max()
            at[k], here[k] = tried[k], s
            move[k], size[k] = np.linalg.lstsq(s[1] + np.diag(ridge + 1e-12), s[0] + ridge * at[k], rcond=None)[0], 1.0
            if step < tolerance:
                done.add(k)
    return {k: LogisticModel(tuple(features), tuple(map(float, at[k][:-1])), float(at[k][-1])) for k in here}


def out_of_fold(rows: DataFrame, models: Mapping[int, LogisticModel], fold: Column, out: str = "p") -> DataFrame:
    """``rows`` with the probability by the model of their own fold, which did not learn from them; null without a model."""
    p = F.lit(None).cast("double")
    for k, m in models.items():
        if k >= 0:
            p = F.when(fold == k, m.predict()).otherwise(p)
    return rows.withColumn(out, p)


def out_of_fold_thresholds(closed: DataFrame, opened: DataFrame, *, n_folds: int, max_false_accept: float = 0.10, bins: int = 20, min_rows: int = 10, default: float = 0.01) -> DataFrame:
    """(fold, s_floor, delta) for each fold, chosen on the rows of the others.

    ``closed`` has fold, margin and correct; ``opened`` fold and s1. ``s_floor`` is the quantile of the scores of absent types above
    which at most the given share is accepted, ``delta`` the upper edge of the last margin bin with enough rows of which less
    than half are right."""
    others = lambda df: df.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1)))).where("_k <> fold")
    floor = others(opened.select("fold", "s1")).groupBy("_k").agg(F.percentile("s1", F.lit(1 - max_false_accept)).alias("s_floor"))
    share = others(closed.select("fold", "margin", "correct")).withColumn("_b", F.least(F.floor(F.col("margin") * bins), F.lit(bins - 1)))
    low = share.groupBy("_k", "_b").agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("double")).alias("acc")).where((F.col("n") >= min_rows) & (F.col("acc") < 0.5))
    low = low.groupBy("_k").agg(((F.max("_b") + 1) / bins).alias("delta"))
    folds = closed.sparkSession.range(n_folds).select(F.col("id").cast("int").alias("fold"))
    rows = folds.join(floor, folds["fold"] == floor["_k"], "left").drop("_k").join(low, folds["fold"] == low["_k"], "left").drop("_k")
    return rows.select("fold", F.coalesce("s_floor", F.lit(0.0)).alias("s_floor"), F.coalesce("delta", F.lit(default)).alias("delta"))


def calibration_report(closed: DataFrame, opened: DataFrame, features: Mapping[str, Sequence[str]], *, n_folds: int = 5, seed: int = 0, accept: float = 0.8, max_false_accept: float = 0.10, bins: int = 10) -> DataFrame:
    """(variant, n, ece_oof, brier_oof, coverage, accuracy_covered, false_accept_open) for each variant of features.

    Folds are those of the reference types, so that neither the model nor the thresholds of a row have seen its type, in the closed
    and in the open records alike. ``closed`` and ``opened`` are records of ``run_benchmark`` and should be settled."""
    closed, opened = closed.withColumn("fold", fold_of(F.col("type"), n_folds, seed)), opened.withColumn("fold", fold_of(F.col("type"), n_folds, seed))
    limits = F.broadcast(out_of_fold_thresholds(closed, opened, n_folds=n_folds, max_false_accept=max_false_accept))  # a row per fold
    out = None
    for variant, names in features.items():
        models = fit_logistic_folds(closed, names, "correct", F.col("fold"), n_folds=n_folds)
        taken = (F.col("p") >= accept) & (F.col("s1") >= F.col("s_floor"))
        scored = lambda df, m=models: out_of_fold(df, m, F.col("fold")).where("p IS NOT NULL").join(limits, "fold").withColumn("taken", F.coalesce(taken, F.lit(False)))
        c = scored(closed).withColumn("y", F.col("correct").cast("double"))
        per_bin = c.groupBy(F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).alias("b")).agg(
            F.count("*").alias("n"), F.sum("p").alias("p"), F.sum("y").alias("y"), F.sum((F.col("p") - F.col("y")) ** 2).alias("sq"), F.count_if("taken").alias("k"), F.sum(F.when(F.col("taken"), F.col("y"))).alias("right")
        )
        row = per_bin.agg(
            F.sum("n").alias("n"),
            (F.sum(F.abs(F.col("p") - F.col("y"))) / F.sum("n")).alias("ece_oof"),
            (F.sum("sq") / F.sum("n")).alias("brier_oof"),
            (F.sum("k") / F.sum("n")).alias("coverage"),
            F.try_divide(F.sum("right"), F.sum("k")).alias("accuracy_covered"),
        )
        false = scored(opened).agg(F.avg(F.col("taken").cast("double")).alias("false_accept_open"))
        row = row.join(F.broadcast(false)).select(F.lit(variant).alias("variant"), "*")  # one row each
        out = row if out is None else out.unionByName(row)
    return out
