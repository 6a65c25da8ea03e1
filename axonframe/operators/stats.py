"""Statistics of experiments: effect sizes, bootstrap intervals, rank tests, BH q-values, hit scoring."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import axis_outcome, hash_uniform, tier, variant_label, jaccard

D_LIMIT = 10.0
N_BOOT = 2000


def cohens_d(a: np.ndarray, b: np.ndarray) -> float:
    """Standardised difference a - b over the pooled deviation, clipped; 0 if both are constant and equal."""
    na, nb, diff = len(a), len(b), float(np.mean(a) - np.mean(b))
    pooled = math.sqrt(((na - 1) * np.var(a, ddof=1) + (nb - 1) * np.var(b, ddof=1)) / (na + nb - 2)) if na > 1 and nb > 1 else 0.0
    if pooled == 0:
        return 0.0 if diff == 0 else math.copysign(D_LIMIT, diff)
    return float(np.clip(diff / pooled, -D_LIMIT, D_LIMIT))


def average_ranks(x: np.ndarray) -> np.ndarray:
    _, inverse, n = np.unique(x, return_inverse=True, return_counts=True)
    last = np.cumsum(n)
    return ((last - n + 1 + last) / 2)[inverse]


def _normal_tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def mann_whitney(a: np.ndarray, b: np.ndarray) -> float:
    """Two-sided p; exact for small samples without ties, else normal with tie and continuity correction.
    Two constant groups give 1 if equal, else 0."""
    if np.ptp(a) == 0 and np.ptp(b) == 0:
        return 1.0 if a[0] == b[0] else 0.0
    na, nb = len(a), len(b)
    ranks = average_ranks(np.concatenate([a, b]))
    u = float(ranks[:na].sum() - na * (na + 1) / 2)
    _, ties = np.unique(np.concatenate([a, b]), return_counts=True)
    if min(na, nb) <= 8 and (ties == 1).all():
        ways = np.zeros((na + 1, na * nb + 1))
        ways[0, 0] = 1
        for k in range(1, na + nb + 1):  # subsets of ranks by size and rank sum less its minimum
            for size in range(min(k, na), 0, -1):
                shift = k - size
                if shift <= na * nb:
                    ways[size, shift:] += ways[size - 1, : na * nb + 1 - shift]
        dist = ways[na] / ways[na].sum()
        big = max(u, na * nb - u)
        return float(min(1.0, 2 * dist[math.ceil(big) :].sum()))
    n = na + nb
    var = na * nb / 12 * (n + 1 - float((ties**3 - ties).sum()) / (n * (n - 1)))
    return min(1.0, _normal_tail(max(0.0, abs(u - na * nb / 2) - 0.5) / math.sqrt(var)))


def wilcoxon(a: np.ndarray, b: np.ndarray) -> float:
    """Two-sided signed-rank p of paired samples (zeros dropped); 1 if all differences are 0."""
    if len(a) != len(b):
        raise ValueError("paired samples differ in length")
    d = np.asarray(a, float) - np.asarray(b, float)
    d = d[d != 0]
    n = len(d)
    if not n:
        return 1.0
    ranks = average_ranks(np.abs(d))
    w = float(min(ranks[d > 0].sum(), ranks[d < 0].sum()))
    _, ties = np.unique(np.abs(d), return_counts=True)
    if n <= 50 and (ties == 1).all():
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for r in range(1, n + 1):
            ways[r:] = ways[r:] + ways[: len(ways) - r].copy()
        return float(min(1.0, 2 * ways[: int(w) + 1].sum() / 2.0**n))
    var = n * (n + 1) * (2 * n + 1) / 24 - float((ties**3 - ties).sum()) / 48
    return min(1.0, _normal_tail((w - n * (n + 1) / 4) / math.sqrt(var)))


def bootstrap_ci(diff, n_boot: int = N_BOOT, seed: int = 0) -> tuple[float, float]:
    """2.5 and 97.5 percentiles of ``diff(rng)`` over seeded resamples."""
    rng = np.random.default_rng(seed)
    draws = [diff(rng) for _ in range(n_boot)]
    return float(np.percentile(draws, 2.5)), float(np.percentile(draws, 97.5))


def compare_groups(a: Sequence[float], b: Sequence[float], *, seed: int = 0) -> dict[str, float]:
    """Means, difference a - b with a bootstrap interval, effect size and rank-test p of two samples."""
    x, y = np.asarray(a, float), np.asarray(b, float)
    lo, hi = bootstrap_ci(lambda r: r.choice(x, len(x)).mean() - r.choice(y, len(y)).mean(), seed=seed)
    return {"mean_a": float(x.mean()), "mean_b": float(y.mean()), "difference": float(x.mean() - y.mean()), "ci_low": lo, "ci_high": hi, "cohens_d": cohens_d(x, y), "p_value": mann_whitney(x, y)}


def compare_paired(a: Sequence[float], b: Sequence[float], *, seed: int = 0) -> dict[str, float]:
    x, y = np.asarray(a, float), np.asarray(b, float)
    p, d = wilcoxon(x, y), x - y
    lo, hi = bootstrap_ci(lambda r: r.choice(d, len(d)).mean(), seed=seed)
    return {"mean_a": float(x.mean()), "mean_b": float(y.mean()), "difference": float(d.mean()), "ci_low": lo, "ci_high": hi, "cohens_d": cohens_d(x, y), "p_value": p}


#: Ranks per bucket of the two-level minima of ``bh_qvalues``.
RANKS = 65_536


def bh_qvalues(df: DataFrame, p: str = "p_value", out: str = "q_value", *, family: Sequence[str] = ()) -> DataFrame:
    """Benjamini-Hochberg q-values; the whole table is one family unless ``family`` columns are given.

    The whole table is ranked by a range sort. The least p n / rank among higher ranks is that of the later buckets
    of ranks or of the later rows in the bucket, so no task sees all rows. Rows without a p have none."""
    if family:
        up, down = W.partitionBy(*family).orderBy(p), W.partitionBy(*family).orderBy(F.desc("_rank")).rowsBetween(W.unboundedPreceding, W.currentRow)
        known = df.where(F.col(p).isNotNull()).withColumn("_rank", F.row_number().over(up)).withColumn("_n", F.count("*").over(W.partitionBy(*family)))
        done = known.withColumn(out, F.least(F.min(F.col(p) * F.col("_n") / F.col("_rank")).over(down), F.lit(1.0))).drop("_rank", "_n")
    else:
        from .nulls import _ranked

        ranked = _ranked(df.where(F.col(p).isNotNull()), [F.col(p)], "_rank")
        total = ranked.agg(F.count("*").alias("_n"))
        rows = ranked.join(F.broadcast(total)).withColumn("_q", F.col(p) * F.col("_n") / F.col("_rank")).withColumn("_b", F.floor((F.col("_rank") - 1) / RANKS))
        later = W.orderBy(F.desc("_b")).rowsBetween(W.unboundedPreceding, -1)
        buckets = rows.groupBy("_b").agg(F.min("_q").alias("_m")).select("_b", F.coalesce(F.min("_m").over(later), F.lit(1.0)).alias("_later"))
        inside = W.partitionBy("_b").orderBy(F.desc("_rank")).rowsBetween(W.unboundedPreceding, W.currentRow)
        done = rows.join(F.broadcast(buckets), "_b").withColumn(out, F.least(F.min("_q").over(inside), "_later", F.lit(1.0))).drop("_rank", "_n", "_q", "_b", "_later")
    return done.select(*df.columns, out).unionByName(df.where(F.col(p).isNull()).select(*df.columns, F.lit(None).cast("double").alias(out)))


def rank_within(df: DataFrame, group: str, value: str, tie: str, out: str = "rank") -> DataFrame:
    """Rank by size of the absolute value inside each group, ties by ``tie``."""
    return df.withColumn(out, F.row_number().over(W.partitionBy(group).orderBy(F.desc(F.abs(value)), tie)))


def running_eligible(df: DataFrame, score: str, label: str, eligible: Column, max_items: int) -> DataFrame:
    """Adds ``taken``: eligible rows among the first ``max_items`` eligible ones by score, ties by label.

    Only the last of these rows is looked up; the others are known by comparison with it."""
    last = df.where(eligible).orderBy(F.desc(score), label).limit(max_items).agg(F.max(F.struct((-F.col(score)).alias("s"), F.col(label).alias("l"))).alias("_last"))
    place = F.struct((-F.col(score)).alias("s"), F.col(label).alias("l"))
    return df.join(F.broadcast(last)).withColumn("taken", F.coalesce(eligible & (place <= F.col("_last")), F.lit(False))).drop("_last")


def pathway_scores(paths: DataFrame) -> DataFrame:
    """(neuron_id, score, signed_score, n_paths) over the inner nodes of paths."""
    inner = paths.where(F.size("path") > 2).select(F.explode(F.array_distinct(F.slice("path", 2, F.size("path") - 2))).alias("neuron_id"), "strength", "path_sign")
    return inner.groupBy("neuron_id").agg(F.sum("strength").alias("score"), F.sum(F.col("strength") * F.col("path_sign")).alias("signed_score"), F.count("*").alias("n_paths"))


def null_keys(neurons: DataFrame, groups: DataFrame) -> DataFrame:
    """(label, super_class, bin): the most frequent super class of each group (ties: the smallest, none: unknown)
    and its size bin."""
    from ..functions.scalars import size_bin

    m = groups.join(neurons.select("neuron_id", "super_class"), "neuron_id", "left")
    size = m.groupBy("label").agg(F.count("*").alias("n"))
    mode = m.where(F.col("super_class").isNotNull()).groupBy("label", "super_class").agg(F.count("*").alias("c"))
    best = mode.withColumn("r", F.row_number().over(W.partitionBy("label").orderBy(F.desc("c"), "super_class"))).where("r = 1").select("label", "super_class")
    return size.join(best, "label", "left").select("label", F.coalesce("super_class", F.lit("unknown")).alias("super_class"), size_bin(F.col("n")).alias("bin"))


def draw_null_sets(neurons: DataFrame, keys: DataFrame, excluded: DataFrame, *, n_sets: int, seed: int, pool: DataFrame | None = None) -> DataFrame:
    """(super_class, bin, set, neuron_id): per key ``n_sets`` samples without replacement of ``bin`` neurons of the
    super class, outside ``excluded`` and inside ``pool``; keys with too few neurons give no rows."""
    wanted = keys.select("super_class", "bin").distinct()
    ids = neurons.select("neuron_id", F.coalesce("super_class", F.lit("unknown")).alias("super_class")).join(excluded.select("neuron_id"), "neuron_id", "left_anti")
    if pool is not None:
        ids = ids.join(pool.select("neuron_id"), "neuron_id", "left_semi")
    enough = ids.groupBy("super_class").agg(F.count("*").alias("_have"))
    rows = wanted.join(enough, "super_class").where("_have >= bin").join(ids, "super_class").withColumn("set", F.explode(F.sequence(F.lit(0), F.lit(n_sets - 1))))
    u = hash_uniform(F.lit(seed), F.col("super_class"), F.col("bin"), F.col("set"), F.col("neuron_id"))
    order = W.partitionBy("super_class", "bin", "set").orderBy("u", "neuron_id")
    return rows.withColumn("u", u).withColumn("r", F.row_number().over(order)).where("r <= bin").select("super_class", "bin", "set", "neuron_id")


def null_p_values(effects: DataFrame, nulls: DataFrame, on: Sequence[str]) -> DataFrame:
    """``effects`` (difference) with ``null_p``: (1 + nulls at least as large in the effect's direction) / (n + 1)."""
    s = F.when(F.col("difference") >= 0, 1.0).otherwise(-1.0)
    n = nulls.where(F.col("null_difference").isNotNull() & ~F.isnan("null_difference"))
    got = effects.join(n, list(on), "left").groupBy(*effects.columns).agg(F.count("null_difference").alias("_n"), F.count_if(F.col("null_difference") * s >= F.col("difference") * s).alias("_k"))
    return got.withColumn("null_p", F.when(~F.isnan("difference"), (1 + F.col("_k")) / (F.col("_n") + 1))).drop("_n", "_k")


def score_hits(effects: DataFrame, *, alpha: float = 0.05, sampled_axes: Sequence[str] = ("nt",)) -> DataFrame:
    """Hits and their robustness from effects (axis, variant, candidate, role, difference, ci_low, ci_high,
    q_value): reference rows under ``alpha`` with an effect, each variant's label, an outcome per axis, a tier."""
    ref = effects.where((F.col("axis") == "reference") & (F.col("role") == "candidate") & (F.col("q_value") < alpha) & F.col("difference").isNotNull() & (F.col("difference") != 0)).select("candidate", F.col("difference").alias("ref"), F.col("q_value").alias("ref_q"))
    rows = effects.where("axis <> 'reference'").join(ref, "candidate").withColumn("label", variant_label(F.col("ref"), F.col("difference"), F.col("ci_low"), F.col("ci_high")))
    per_axis = rows.groupBy("candidate", "axis").agg(F.count("*").alias("n"), F.count_if(F.col("label") == "holds").alias("holds"))
    outcome = F.when(F.col("axis").isin(*sampled_axes), axis_outcome(F.col("n"), F.col("holds"), sampled=True)).otherwise(axis_outcome(F.col("n"), F.col("holds"), sampled=False))
    per_axis = per_axis.withColumn("outcome", outcome)
    total = per_axis.groupBy("candidate").agg(F.count("*").alias("n_axes"), F.count_if(F.col("outcome") == "fail").alias("n_failed"), F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "axis", "outcome"))), ",").alias("axes"))
    return ref.join(total, "candidate", "left").select("candidate", F.col("ref").alias("difference"), F.col("ref_q").alias("q_value"), F.coalesce("n_axes", F.lit(0)).alias("n_axes"), F.coalesce("n_failed", F.lit(0)).alias("n_failed"), F.coalesce("axes", F.lit("")).alias("axes"), tier(F.coalesce("n_axes", F.lit(0)), F.coalesce("n_failed", F.lit(0))).alias("tier"))


GRADED = ("w_syn", "nt", "min_weight", "random_null")


def robust_hits(effects: DataFrame, *, alpha: float = 0.05, null_alpha: float = 0.05, null_p: DataFrame | None = None, replicate: DataFrame | None = None) -> DataFrame:
    """The hits of a screen with their robustness, the best tier and the largest effects first.

    A hit is a candidate whose reference effect is not 0 at a q-value under ``alpha``. Per axis the variants' labels
    give robust or fails (of ``nt`` three quarters must hold), or not_run; ``null_p`` (candidate, null_p, degenerate)
    gives the random null, which is uninformative if half of the sets change nothing; ``replicate`` has (candidate,
    replicate)."""
    ref = effects.where((F.col("axis") == "reference") & (F.col("role") == "candidate") & (F.col("q_value") < alpha) & F.col("difference").isNotNull() & (F.col("difference") != 0))
    ref = ref.select("candidate", "difference", "ci_low", "ci_high", "q_value", F.when(F.col("difference") < 0, "down").otherwise("up").alias("direction"))
    rows = effects.where(F.col("axis").isin(*GRADED[:3])).select("axis", "variant", "candidate", F.col("difference").alias("d"), F.col("ci_low").alias("lo"), F.col("ci_high").alias("hi")).join(ref.select("candidate", "difference"), "candidate")
    rows = rows.withColumn("label", variant_label(F.col("difference"), F.col("d"), F.col("lo"), F.col("hi")))
    of = lambda axis, what: F.filter(F.array_sort(F.collect_list(F.when(F.col("axis") == axis, F.struct("variant", "label")))), what)
    every = lambda x: F.lit(True)  # noqa: E731, ARG005
    per = rows.groupBy("candidate").agg(*(of(a, every).alias(f"_{a}") for a in GRADED[:3]))
    out = ref.join(per, "candidate", "left")
    names = {}
    for a in GRADED[:3]:
        n = F.coalesce(F.size(f"_{a}"), F.lit(0))
        holds = F.coalesce(F.size(F.filter(f"_{a}", lambda x: x["label"] == "holds")), F.lit(0))
        need = F.ceil(n * 0.75) if a == "nt" else n
        names[a] = F.when(n <= 0, "not_run").when(holds >= need, "robust").otherwise("fails")
        detail = F.array_join(F.transform(f"_{a}", lambda x: F.concat_ws(": ", x["variant"], x["label"])), ", ")
        if a == "nt":
            names["nt_holds"] = F.concat_ws("/", F.greatest(holds, F.lit(0)).cast("string"), F.greatest(n, F.lit(0)).cast("string"))
            names["nt_flips"] = F.coalesce(F.array_join(F.transform(F.filter("_nt", lambda x: x["label"] == "flips"), lambda x: x["variant"]), ", "), F.lit(""))
        else:
            names[f"{a}_detail"] = F.coalesce(detail, F.lit(""))
    out = out.join(null_p.select("candidate", F.col("null_p").alias("random_null_p"), "degenerate"), "candidate", "left") if null_p is not None else out.withColumns({"random_null_p": F.lit(None).cast("double"), "degenerate": F.lit(False)})
    p = F.col("random_null_p")
    names["random_null"] = F.when(p.isNull() | F.isnan(p), "not_run").when(F.coalesce("degenerate", F.lit(False)), "uninformative").when(p < null_alpha, "robust").otherwise("fails")
    out = out.join(replicate.select("candidate", "replicate"), "candidate", "left") if replicate is not None else out.withColumn("replicate", F.lit(None).cast("string"))
    out = out.withColumns(names).withColumn("replicate", F.coalesce("replicate", F.lit("not run")))
    having = lambda what: F.array_join(F.filter(F.array(*(F.when(F.col(a) == what, a) for a in GRADED)), lambda x: x.isNotNull()), ", ")
    count = lambda *what: sum((F.when(F.col(a).isin(*what), 1).otherwise(0) for a in GRADED[1:]), F.when(F.col(GRADED[0]).isin(*what), 1).otherwise(0))
    fails = count("fails")
    out = out.withColumns({"tier": F.when(fails == 0, "Strong").when(fails == 1, "Conditional").otherwise("Fragile"), "thinly_tested": count("fails", "robust") < 2, "failed_axes": having("fails"), "untested_axes": having("not_run"), "uninformative_axes": having("uninformative"), "_order": fails})
    out = out.orderBy(F.least("_order", F.lit(2)), F.desc(F.abs("difference")), "candidate")
    columns = ["candidate", "difference", "ci_low", "ci_high", "q_value", "direction", "w_syn", "w_syn_detail", "nt", "nt_holds", "nt_flips", "min_weight", "min_weight_detail", "random_null", "random_null_p", "replicate"]
    return out.select(*columns, "tier", "thinly_tested", "failed_axes", "untested_axes", "uninformative_axes")
