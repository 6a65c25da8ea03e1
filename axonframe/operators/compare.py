"""Type matching, partner profiles, atlases and cosine classification."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import cosine, params_hash, verdict
from .graph import Graph, label_sums, per_node, sums_by
from .paths import settle

UNMATCHED = "__unmatched__"
MIN_YARDSTICK = 0.05
MIN_OVERLAP = 0.01


def xref_column(columns: Sequence[str], dataset: str, version: str) -> str | None:
    """The column of a table that names another dataset's types, if it has one."""
    prefix = {"flywire": "fafb", "hemibrain": "hemibrain", "manc": "manc", "malecns": "malecns"}.get(dataset)
    name = f"{prefix}_{version.replace('.', '')}_cell_type"
    return name if prefix and name in columns else None


def match_types(a: DataFrame, b: DataFrame, xref: str) -> DataFrame:
    """(type_a, type_b, n_a, n_b): types of ``a`` joined to types of ``b`` through the comma list in ``xref``."""
    left = a.where(F.col("cell_type").isNotNull() & F.col(xref).isNotNull()).groupBy(F.col("cell_type").alias("type_a"), F.col(xref).alias("_x")).agg(F.count("*").alias("n_a"))
    left = left.withColumn("type_b", F.explode(F.split("_x", ","))).withColumn("type_b", F.trim("type_b")).drop("_x")
    right = b.where(F.col("cell_type").isNotNull()).groupBy(F.col("cell_type").alias("type_b")).agg(F.count("*").alias("n_b"))
    return left.join(right, "type_b").select("type_a", "type_b", "n_a", "n_b").orderBy("type_a", "type_b")


def partner_labels(nodes: DataFrame, vocabulary: str = "cell_type") -> DataFrame:
    """(neuron_id, label): the cell type, or the first cross-reference; the cell type if both are wholly empty.
    An empty string is no label here."""
    label = F.col("cell_type")
    if vocabulary == "fafb_or_manc":
        both = F.coalesce(F.nullif("fafb_783_cell_type", F.lit("")), F.nullif("manc_121_cell_type", F.lit("")))
        if nodes.where(both.isNotNull()).limit(1).count():
            label = both
    return nodes.select("neuron_id", F.nullif(label.cast("string"), F.lit("")).alias("label"))


def vocab_partner_names(nodes: DataFrame, known: DataFrame, vocabulary: str = "fafb_or_manc") -> DataFrame:
    """(neuron_id, label): of a neuron's cross-references the first that is among ``known`` (label), so that a neuron
    with names of two datasets takes the one an atlas has. Without any cross-reference, ``partner_labels``."""
    names = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in ("fafb_783_cell_type", "manc_121_cell_type") if c in nodes.columns]
    if vocabulary != "fafb_or_manc" or not names or nodes.where(F.coalesce(*names).isNotNull()).isEmpty():
        return partner_labels(nodes, vocabulary if vocabulary != "fafb_or_manc" else "cell_type")
    labels, out = known.select("label").where("label is not null").distinct(), nodes.select("neuron_id", *(n.alias(f"_n{i}") for i, n in enumerate(names)))
    for i in range(len(names)):
        out = out.join(labels.select(F.col("label").alias(f"_l{i}")), F.col(f"_n{i}") == F.col(f"_l{i}"), "left")
    return out.select("neuron_id", F.coalesce(*(F.col(f"_l{i}") for i in range(len(names)))).alias("label"))


def partner_counts(graph: Graph, labels: DataFrame) -> DataFrame:
    """(neuron_id, dir, label, value): weight to (out) and from (in) partners by label; null label: unlabelled."""
    names = per_node(labels.select("neuron_id", "label"))
    half = lambda own, name: sums_by(graph, own, names, "left").select(F.col(own).alias("neuron_id"), F.lit(name).alias("dir"), "label", F.col("weight").alias("value"))
    return half("pre", "out").unionByName(half("post", "in"))


def profiles(counts: DataFrame, *, direction: str = "both", mask: Sequence[str] = ()) -> DataFrame:
    """Labelled counts outside ``mask``, each half (out, in) of a neuron normalised to sum 1."""
    kept = counts.where(F.col("label").isNotNull())
    if mask:
        kept = kept.where(~F.col("label").isin(list(mask)))
    if direction != "both":
        kept = kept.where(F.col("dir") == direction)
    total = F.sum("value").over(W.partitionBy("neuron_id", "dir"))
    return kept.withColumn("value", F.when(total > 0, F.col("value") / total).otherwise(F.lit(0.0)))


def unlabelled_fraction(counts: DataFrame) -> DataFrame:
    """(neuron_id, labelled, total, unlabelled_fraction): 1 - labelled / total weight, 1 without any weight."""
    t = counts.groupBy("neuron_id").agg(F.coalesce(F.sum(F.when(F.col("label").isNotNull(), F.col("value"))), F.lit(0)).alias("labelled"), F.sum("value").alias("total"))
    return t.withColumn("unlabelled_fraction", F.when(F.col("total") > 0, 1 - F.col("labelled") / F.col("total")).otherwise(F.lit(1.0)))


def labelled_mass(counts: DataFrame) -> float:
    r = counts.agg(F.sum(F.when(F.col("label").isNotNull(), F.col("value"))).alias("a"), F.sum("value").alias("b")).first()
    return float(r["a"] or 0) / r["b"] if r["b"] else 0.0


def touching(counts: DataFrame, mask: Sequence[str]) -> DataFrame:
    """Neurons with weight to or from masked labels."""
    return counts.where(F.col("label").isin(list(mask))).select("neuron_id").distinct()


def type_profile(graph: Graph, type_label: str, *, direction: str = "out", by: str = "cell_type", side: str | None = None, type_column: str = "cell_type") -> DataFrame:
    """(label, fraction): mean over the type's neurons of their partner-label fractions; unlabelled partners
    count under ``__unmatched__``; neurons without partners count in the mean."""
    rows = graph.nodes.where(F.col(type_column) == type_label)
    if side is not None:
        rows = rows.where(F.col("side") == side)
    n = rows.count()
    if not n:
        raise ValueError(f"no neurons of type {type_label!r}")
    own = "pre" if direction == "out" else "post"
    names = graph.nodes.select("neuron_id", F.coalesce(F.col(by).cast("string"), F.lit(UNMATCHED)).alias("label"))
    per = label_sums(graph, own, names, among=rows.select("neuron_id"))
    share = per.withColumn("f", F.col("weight") / F.sum("weight").over(W.partitionBy(own)))
    return share.groupBy("label").agg((F.sum("f") / n).alias("fraction")).where("fraction > 0").orderBy(F.desc("fraction"), "label")


@dataclass(frozen=True)
class TypeComparison:
    """Distance of a type between two datasets beyond left-right variation, with a permutation test."""

    statistic: float
    between: float
    within: float
    nulls: tuple[float, ...]
    differences: tuple[tuple[str, float, float], ...]
    unmatched: tuple[float, float]
    caveats: tuple[str, ...]

    @property
    def p(self) -> float:
        return (1 + sum(x >= self.statistic for x in self.nulls)) / (len(self.nulls) + 1)

    @property
    def z(self) -> float:
        sd = float(np.std(self.nulls, ddof=1)) if len(self.nulls) > 1 else 0.0
        return (self.statistic - float(np.mean(self.nulls))) / sd if sd else 0.0

    def verdict(self, spark: SparkSession, alpha: float = 0.05) -> str:
        """The grade of ``functions.scalars.verdict``."""
        return spark.range(1).select(verdict(F.lit(self.p), F.lit(self.statistic), alpha=alpha).alias("v")).first()["v"]

    def summary(self) -> dict[str, float]:
        return {"statistic": self.statistic, "between": self.between, "within": self.within, "z": self.z, "p": self.p, "unmatched_a": self.unmatched[0], "unmatched_b": self.unmatched[1]}


#: Cells of the matrix of one type's neurons by partner labels up to which it is broadcast for permutations.
MAX_CELLS = 20_000_000


def type_rows(graph: Graph, type_label: str, *, direction: str = "out", labels: DataFrame | None = None) -> DataFrame:
    """(neuron_id, side, label, value, unmatched) of the left and right neurons of a type: shares of the weight to
    named partners, and the share of all weight that goes to unnamed ones. A neuron without named partners has one row
    with a null label."""
    members = graph.nodes.where((F.col("cell_type") == type_label) & F.col("side").isin("left", "right")).select("neuron_id", "side")
    return profile_rows(graph, members, direction=direction, labels=labels)


def profile_rows(graph: Graph, members: DataFrame, *, direction: str = "out", labels: DataFrame | None = None) -> DataFrame:
    """``type_rows`` of any neurons (neuron_id, side)."""
    counts = partner_counts(graph, labels if labels is not None else partner_labels(graph.nodes)).where(F.col("dir") == direction)
    counts = counts.join(members.select("neuron_id"), "neuron_id", "left_semi")
    per = W.partitionBy("neuron_id")
    named = F.sum(F.when(F.col("label").isNotNull(), F.col("value"))).over(per)
    rows = counts.withColumn("unmatched", 1 - F.coalesce(named, F.lit(0)) / F.sum("value").over(per)).withColumn("value", F.col("value") / named)
    own = rows.where("label is not null").select("neuron_id", "label", "value")
    lost = rows.groupBy("neuron_id").agg(F.max("unmatched").alias("unmatched"))
    return members.join(own, "neuron_id", "left").join(lost, "neuron_id", "left").select("neuron_id", "side", "label", "value", F.coalesce("unmatched", F.lit(0.0)).alias("unmatched"))


def _cosine_of(u: DataFrame, v: DataFrame, on: list[str]) -> DataFrame:
    """(*on, c): cosine of two tables of means (*on, label, value), absent labels being 0."""
    both = u.withColumnRenamed("value", "u").join(v.withColumnRenamed("value", "v"), [*on, "label"], "full")
    x, y = F.coalesce("u", F.lit(0.0)), F.coalesce("v", F.lit(0.0))
    return both.groupBy(*on).agg(cosine(F.sum(x * y), F.sum(x * x), F.sum(y * y)).alias("c"))


def type_statistic(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (statistic, between, within) from the ``type_rows`` of two datasets: 1 - cosine of their mean shares
    over the union of labels, less the mean 1 - cosine of sides within each."""
    rows = a.withColumn("ds", F.lit("a")).unionByName(b.withColumn("ds", F.lit("b")))

    def means(*by: str) -> DataFrame:
        size = rows.groupBy(*by).agg(F.countDistinct("neuron_id").alias("n"))
        return rows.where("label is not null").groupBy(*by, "label").agg(F.sum("value").alias("s")).join(size, list(by)).select(*by, "label", (F.col("s") / F.col("n")).alias("value"))

    of = lambda df, c, v: df.where(F.col(c) == v).drop(c)
    whole, sided = means("ds"), means("ds", "side")
    between = _cosine_of(of(whole, "ds", "a"), of(whole, "ds", "b"), []).select((1 - F.col("c")).alias("between"))
    have = rows.groupBy("ds").agg(F.countDistinct("side").alias("sides")).where("sides = 2").select("ds")
    pairs = have.join(_cosine_of(of(sided, "side", "left"), of(sided, "side", "right"), ["ds"]), "ds", "left")
    within = pairs.agg(F.coalesce(F.avg(1 - F.coalesce("c", F.lit(0.0))), F.lit(0.0)).alias("within"))
    return between.join(F.broadcast(within)).select((F.col("between") - F.col("within")).alias("statistic"), "between", "within")


def _distance(u: np.ndarray, v: np.ndarray) -> float:
    n = float(np.linalg.norm(u) * np.linalg.norm(v))
    return 1.0 - (float(u @ v) / n if n else 0.0)


def _measure(m: np.ndarray, data: np.ndarray, left: np.ndarray) -> tuple[float, float]:
    mean = lambda rows: m[rows].mean(axis=0)
    sides = [(data == k) & left for k in (0, 1)], [(data == k) & ~left for k in (0, 1)]
    within = [_distance(mean(x), mean(y)) for x, y in zip(*sides, strict=True) if x.any() and y.any()]
    return _distance(mean(data == 0), mean(data == 1)), float(np.mean(within)) if within else 0.0


def compare_type(a: Graph, b: Graph, type_a: str, *, type_b: str | None = None, direction: str = "out", n_permutations: int = 1000, seed: int = 0, labels: tuple[DataFrame, DataFrame] | None = None) -> TypeComparison:
    """Compare the mean partner shares of a type in two datasets over the union of partner labels (see
    ``type_statistic``); the null permutes the dataset within sides.

    The rows of one type are what reaches the driver: neurons by labels, at most ``MAX_CELLS``. Permutations are dealt
    over tasks, each seeded by its number."""
    names = labels or (partner_labels(a.nodes), partner_labels(b.nodes))
    tables = [type_rows(g, t, direction=direction, labels=n).withColumn("which", F.lit(k)) for k, (g, t, n) in enumerate(zip((a, b), (type_a, type_b or type_a), names, strict=True))]
    both = tables[0].unionByName(tables[1]).persist()
    size = both.agg(F.countDistinct("which", "neuron_id").alias("n"), F.countDistinct("label").alias("k"), F.countDistinct("which").alias("w")).first()
    if size["w"] < 2:
        raise ValueError("the type needs left or right neurons in both datasets")
    if size["n"] * max(1, size["k"]) > MAX_CELLS:
        raise ValueError(f"{size['n']} neurons by {size['k']} labels are more than {MAX_CELLS} cells; use type_statistic")
    rows = both.toPandas()
    both.unpersist()
    neurons = rows.drop_duplicates(["which", "neuron_id"]).sort_values(["which", "neuron_id"])
    vocabulary = sorted(rows["label"].dropna().unique())
    at = {x: i for i, x in enumerate(zip(neurons["which"], neurons["neuron_id"], strict=True))}
    col, m = {x: i for i, x in enumerate(vocabulary)}, np.zeros((len(neurons), len(vocabulary)))
    for r in rows.dropna(subset=["label"]).itertuples():
        m[at[r.which, r.neuron_id], col[r.label]] = r.value
    data, left = neurons["which"].to_numpy(), (neurons["side"] == "left").to_numpy()
    between, within = _measure(m, data, left)
    sent = a.spark.sparkContext.broadcast((m, data, left))

    def permute(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, data, left = sent.value
        for f in frames:
            out = []
            for k in f["id"]:
                rng, d = np.random.default_rng([seed, int(k)]), data.copy()
                for x in (left, ~left):
                    d[x] = rng.permutation(d[x])
                u, v = _measure(m, d, left)
                out.append(u - v)
            yield pd.DataFrame({"id": f["id"], "x": out})

    tasks = a.spark.sparkContext.defaultParallelism
    nulls = [r["x"] for r in a.spark.range(0, n_permutations, 1, min(tasks, max(1, n_permutations))).mapInPandas(permute, "id long, x double").orderBy("id").collect()]
    means = [m[data == k].mean(axis=0) for k in (0, 1)]
    diffs = sorted(((x, float(means[0][i]), float(means[1][i])) for x, i in col.items()), key=lambda t: (-abs(t[1] - t[2]), t[0]))
    loss = [float(neurons.loc[neurons["which"] == k, "unmatched"].mean()) for k in (0, 1)]
    caveats = [f"{x:.0%} of the weight is to unmatched partners" for x in loss if x > 0.05] + ["two neurons or fewer in a dataset"] * int(min((data == 0).sum(), (data == 1).sum()) <= 2)
    return TypeComparison(between - within, between, within, tuple(nulls), tuple(diffs), (loss[0], loss[1]), tuple(caveats))


@dataclass(frozen=True)
class Atlas:
    """Labels with members (neuron_id, label), member counts and profiles, centroid ``sums`` (group, dir, label, value),
    yardsticks and the labels that are masked as partners. Profiles and sums are settled once."""

    members: DataFrame
    counts: DataFrame
    profiles: DataFrame
    sums: DataFrame
    yardsticks: DataFrame
    params: dict
    mask: tuple[str, ...] = ()

    @property
    def hash(self) -> str:
        return params_hash(self.params)


def _sums(prof: DataFrame, members: DataFrame) -> DataFrame:
    return prof.join(members.withColumnRenamed("label", "group"), "neuron_id").groupBy("group", "dir", "label").agg(F.sum("value").alias("value"))


def yardsticks(prof: DataFrame, members: DataFrame, sides: DataFrame | None = None) -> DataFrame:
    """(group, neuron_yard, group_yard, fallback): median leave-one-out cosine of a label's neurons to the sum of
    the others, by the closed form, and cosine of the left to the right sum; missing ones take the median of all
    labels (1 if there is none) and are flagged."""
    m = members.select("neuron_id", F.col("label").alias("group"))
    rows = prof.join(m, "neuron_id")
    sums = rows.groupBy("group", "dir", "label").agg(F.sum("value").alias("s"))
    per = rows.join(sums, ["group", "dir", "label"]).groupBy("group", "neuron_id").agg(F.sum(F.col("value") * F.col("s")).alias("dot"), F.sum(F.col("value") * F.col("value")).alias("pp"))
    size = m.groupBy("group").agg(F.count("*").alias("n"))
    norms = sums.groupBy("group").agg(F.sum(F.col("s") * F.col("s")).alias("ss"))
    rest = F.col("ss") - 2 * F.col("dot") + F.col("pp")
    loo = per.join(norms, "group").join(size, "group").where((F.col("n") >= 2) & (F.col("pp") > 0) & (rest > 1e-12)).select("group", ((F.col("dot") - F.col("pp")) / F.sqrt(F.col("pp") * rest)).alias("c"))
    yard = loo.groupBy("group").agg(F.percentile("c", F.lit(0.5)).alias("neuron_yard"))
    out = size.select("group").join(yard, "group", "left")
    if sides is not None:
        s = rows.join(sides.select("neuron_id", "side"), "neuron_id").groupBy("group", "dir", "label").agg(F.coalesce(F.sum(F.when(F.col("side") == "left", F.col("value"))), F.lit(0.0)).alias("l"), F.coalesce(F.sum(F.when(F.col("side") == "right", F.col("value"))), F.lit(0.0)).alias("r"))
        g = s.groupBy("group").agg(F.sum(F.col("l") * F.col("r")).alias("d"), F.sum(F.col("l") * F.col("l")).alias("ll"), F.sum(F.col("r") * F.col("r")).alias("rr"))
        out = out.join(g.select("group", F.when((F.col("ll") > 0) & (F.col("rr") > 0), cosine(F.col("d"), F.col("ll"), F.col("rr"))).alias("group_yard")), "group", "left")
    else:
        out = out.withColumn("group_yard", F.lit(None).cast("double"))
    med = out.agg(F.percentile("neuron_yard", F.lit(0.5)).alias("mn"), F.percentile("group_yard", F.lit(0.5)).alias("mg"))
    return out.crossJoin(F.broadcast(med)).select("group", F.coalesce("neuron_yard", "mn", F.lit(1.0)).alias("neuron_yard"), F.coalesce("group_yard", "mg", F.lit(1.0)).alias("group_yard"), (F.col("neuron_yard").isNull() | F.col("group_yard").isNull()).alias("fallback"))


def build_atlas(graph: Graph, *, groups: DataFrame | None = None, vocabulary: str = "cell_type", direction: str = "both", mask: Sequence[str] = ()) -> Atlas:
    """An atlas of the cell types, or of ``groups`` (label, neuron_id)."""
    members = groups.select("neuron_id", "label") if groups is not None else graph.nodes.select("neuron_id", F.nullif("cell_type", F.lit("")).alias("label")).where("label is not null")
    if groups is not None and members.groupBy("neuron_id").agg(F.countDistinct("label").alias("n")).where("n > 1").limit(1).count():
        raise ValueError("groups overlap")
    if not members.limit(1).count():
        raise ValueError("no labelled neurons")
    counts = partner_counts(graph, partner_labels(graph.nodes, vocabulary)).join(members.select("neuron_id"), "neuron_id", "left_semi")
    counts = settle(counts.where(F.col("dir") == direction) if direction != "both" else counts)
    prof = settle(profiles(counts, mask=mask))
    params = {"vocabulary": vocabulary, "direction": direction, "mask": sorted(mask), "min_weight": graph.provenance.get("min_weight")}
    return Atlas(members, counts, prof, settle(_sums(prof, members)), settle(yardsticks(prof, members, graph.nodes if "side" in graph.nodes.columns else None)), params, tuple(sorted(mask)))


def masked_atlas(atlas: Atlas, mask: Sequence[str] = (), drop: Sequence[str] = ()) -> Atlas:
    """The atlas with more partner labels masked (those masked before stay so) and without dropped groups. Profiles
    that touch a newly masked label are made anew; yardsticks stay those of the unmasked atlas."""
    full, new = tuple(sorted({*atlas.mask, *mask})), sorted(set(mask) - set(atlas.mask))
    members = atlas.members.where(~F.col("label").isin(list(drop))) if drop else atlas.members
    if not new:
        sums = atlas.sums.where(~F.col("group").isin(list(drop))) if drop else atlas.sums
        return replace(atlas, members=members, sums=sums, mask=full)
    touched = touching(atlas.counts, new)
    again = profiles(atlas.counts.join(touched, "neuron_id", "left_semi"), mask=full)
    prof = settle(atlas.profiles.join(touched, "neuron_id", "left_anti").unionByName(again.select(atlas.profiles.columns)))
    return replace(atlas, members=members, profiles=prof, sums=settle(_sums(prof, members)), mask=full)


def score(atlas: Atlas, prof: DataFrame, *, level: str = "neuron", top_k: int = 5) -> DataFrame:
    """(neuron_id, rank, group, s, a): the ``top_k`` labels by cosine to their sums, ties (to ten digits) by label; labels at
    cosine 0 fill up; a = s over the label's yardstick.

    Only labels that share a partner with a neuron meet it; the first k + matches labels in order fill the rest."""
    sums = atlas.sums
    norm = sums.groupBy("group").agg(F.sum(F.col("value") * F.col("value")).alias("gg"))
    own = prof.groupBy("neuron_id").agg(F.sum(F.col("value") * F.col("value")).alias("qq"))
    dots = prof.join(sums.withColumnRenamed("value", "g"), ["dir", "label"]).groupBy("neuron_id", "group").agg(F.sum(F.col("value") * F.col("g")).alias("dot"))
    s = dots.join(own, "neuron_id").join(norm, "group").select("neuron_id", "group", cosine(F.col("dot"), F.col("qq"), F.col("gg")).alias("s"))
    names = [r["group"] for r in atlas.yardsticks.join(atlas.members.select(F.col("label").alias("group")).distinct(), "group", "left_semi").orderBy("group").select("group").limit(2 * top_k).collect()]
    order = W.partitionBy("neuron_id").orderBy(F.desc(F.round("s", 10)), "group")
    best = s.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k).drop("rank")
    filler = own.select("neuron_id", F.explode(F.lit(names)).alias("group")).join(best.select("neuron_id", "group"), ["neuron_id", "group"], "left_anti").withColumn("s", F.lit(0.0)) if names else best.limit(0)
    ranked = best.unionByName(filler.select("neuron_id", "group", "s")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)
    yard = "neuron_yard" if level == "neuron" else "group_yard"
    return ranked.join(atlas.yardsticks.select("group", yard), "group").select("neuron_id", "rank", "group", "s", (F.col("s") / F.greatest(F.col(yard), F.lit(MIN_YARDSTICK))).alias("a"))


def wide_scores(scored: DataFrame) -> DataFrame:
    """(neuron_id, top, s1, a1, margin, labels, scores) from ranked scores; margin is s1 less the runner-up."""
    rows = scored.groupBy("neuron_id").agg(F.sort_array(F.collect_list(F.struct("rank", "group", "s", "a"))).alias("r"))
    first = F.col("r")[0]
    second = F.get("r", F.lit(1))["s"]
    return rows.select("neuron_id", first["group"].alias("top"), first["s"].alias("s1"), first["a"].alias("a1"), (first["s"] - F.coalesce(second, F.lit(0.0))).alias("margin"), F.transform("r", lambda x: x["group"]).alias("labels"), F.transform("r", lambda x: x["s"]).alias("scores"))


@dataclass(frozen=True)
class LogisticModel:
    """Weights on named features and an intercept."""

    features: tuple[str, ...]
    coef: tuple[float, ...]
    intercept: float

    def predict(self) -> Column:
        z = F.lit(self.intercept)
        for f, c in zip(self.features, self.coef, strict=True):
            z = z + F.col(f) * c
        return 1 / (1 + F.exp(-z))


def fit_logistic(x: np.ndarray, y: np.ndarray, *, features: Sequence[str], l2: float = 1e-4) -> LogisticModel:
    """L2 (not on the intercept) logistic regression by Newton steps; both outcomes are needed."""
    y = np.asarray(y, float)
    if not 0 < y.mean() < 1:
        raise ValueError("both outcomes are needed")
    z = np.column_stack([np.asarray(x, float), np.ones(len(y))])
    w, ridge = np.zeros(z.shape[1]), np.full(z.shape[1], l2)
    ridge[-1] = 0

    def loss(v: np.ndarray) -> float:
        m = z @ v
        return float(np.logaddexp(0, m).sum() - y @ m + 0.5 * (ridge * v * v).sum())

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -500, 500)))
        g = z.T @ (p - y) + ridge * w
        h = (z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge + 1e-12)
        step, t = np.linalg.lstsq(h, g, rcond=None)[0], 1.0
        while t > 1e-8 and loss(w - t * step) > loss(w):
            t /= 2
        w = w - t * step
        if np.abs(t * step).max() < 1e-9:
            break
    return LogisticModel(tuple(features), tuple(map(float, w[:-1])), float(w[-1]))


def apply_calls(wide: DataFrame, p: Column, *, s_floor: float, delta: float, accept: float) -> DataFrame:
    """``call`` and ``called``: unknown below the floor; type at ``accept`` or more; else ambiguous with all top
    labels within ``delta`` of the best, joined by a pipe."""
    near = F.filter(F.arrays_zip("labels", "scores"), lambda x: x["scores"] >= F.col("s1") - delta)
    call = F.when(F.col("s1") < s_floor, "unknown").when(F.col("p") >= accept, "type").otherwise("ambiguous")
    called = F.when(F.col("call") == "type", F.col("top")).when(F.col("call") == "ambiguous", F.array_join(F.transform(near, lambda x: x["labels"]), "|"))
    return wide.withColumn("p", p).withColumn("call", call).withColumn("called", called)


def ece_bins(df: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """(bin, n, mean_p, accuracy) over equal-width bins; rows that are not finite are dropped."""
    ok = F.col(p).isNotNull() & ~F.isnan(p) & F.col(y).isNotNull()
    return df.where(ok).groupBy(F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("accuracy"))


def ece(df: DataFrame, p: str, y: str, bins: int = 10) -> float:
    b = ece_bins(df, p, y, bins).collect()
    n = sum(r["n"] for r in b)
    return sum(r["n"] * abs(r["mean_p"] - r["accuracy"]) for r in b) / n if n else math.nan


def brier(df: DataFrame, p: str, y: str) -> float:
    return df.agg(F.avg(F.pow(F.col(p) - F.col(y).cast("double"), 2)).alias("b")).first()["b"]


def choose_s_floor(open_scores: DataFrame, *, max_false_accept: float = 0.10) -> float:
    """The quantile of s1 of queries whose type is absent, above which at most the given share is accepted."""
    x = open_scores.agg(F.percentile("s1", F.lit(1 - max_false_accept)).alias("q")).first()["q"]
    return float(x) if x is not None else 0.0


def choose_delta(closed: DataFrame, *, bins: int = 20, min_rows: int = 10, default: float = 0.01) -> float:
    """The upper edge of the last margin bin with enough rows whose accuracy is under one half."""
    b = closed.groupBy(F.least(F.floor(F.col("margin") * bins), F.lit(bins - 1)).alias("b")).agg(F.count("*").alias("n"), F.avg(F.col("right").cast("double")).alias("acc"))
    x = b.where((F.col("n") >= min_rows) & (F.col("acc") < 0.5)).agg(F.max("b").alias("b")).first()["b"]
    return (x + 1) / bins if x is not None else default


def truth_labels(nodes: DataFrame, column: str, labels: DataFrame) -> DataFrame:
    """(neuron_id, truth): single-name cross-references that the reference has."""
    return nodes.where(F.col(column).isNotNull() & ~F.contains(F.col(column), F.lit(","))).select("neuron_id", F.trim(column).alias("truth")).join(labels.select(F.col("label").alias("truth")).distinct(), "truth", "left_semi").select("neuron_id", "truth")


def votes(wide: DataFrame, n: int = 10) -> DataFrame:
    """The labels that most neurons have on top, ties by label."""
    return wide.groupBy(F.col("top").alias("label")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(n)


def classify(query: Graph, atlas: Atlas, *, ids: Sequence[int] | None = None, cell_type: str | None = None, partner_names: DataFrame | None = None, mask: Sequence[str] = (), mask_self: bool = True, top_k: int = 5, model: LogisticModel | None = None, s_floor: float = 0.2, delta: float = 0.01, accept: float = 0.8) -> DataFrame:
    """Calls for the neurons of a type or of an id list. Partners take the names that the atlas has, or ``partner_names``
    (neuron_id, label); if less than ``MIN_OVERLAP`` of the weight goes to such names, that is an error. ``mask`` and, with
    ``mask_self``, the neurons' own names are masked on both sides."""
    from .graph import id_frame

    if (ids is None) == (cell_type is None):
        raise ValueError("give one of ids and cell_type")
    rows = query.nodes.where(F.col("cell_type") == cell_type) if ids is None else query.nodes.join(id_frame(query.nodes, ids, "neuron_id"), "neuron_id", "left_semi")
    known = atlas.counts.select("label").where("label is not null").distinct()
    names = settle(partner_names.select("neuron_id", "label") if partner_names is not None else vocab_partner_names(query.nodes, known, atlas.params["vocabulary"]))
    every = partner_counts(query, names)
    every = every.where(F.col("dir") == atlas.params["direction"]) if atlas.params["direction"] != "both" else every
    every = settle(every.join(known.select(F.col("label").alias("_k")), F.col("label") == F.col("_k"), "left").select("neuron_id", "dir", F.col("_k").alias("label"), "value").groupBy("neuron_id", "dir", "label").agg(F.sum("value").alias("value")))
    share = labelled_mass(every)
    if share < MIN_OVERLAP and not every.isEmpty():
        raise ValueError(f"only {share:.2%} of the weight goes to partners with names of the atlas")
    counts = every.join(rows.select("neuron_id"), "neuron_id", "left_semi")
    own = [r["label"] for r in names.join(rows.select("neuron_id"), "neuron_id", "left_semi").where("label is not null").select("label").distinct().collect()] if mask_self else []
    hidden = sorted({*mask, *own})
    atlas = masked_atlas(atlas, hidden) if hidden else atlas
    wide = wide_scores(score(atlas, profiles(counts, mask=atlas.mask), top_k=top_k))
    called = apply_calls(wide, model.predict() if model else F.least(F.greatest(F.col("a1"), F.lit(0.0)), F.lit(1.0)), s_floor=s_floor, delta=delta, accept=accept)
    out = rows.select("neuron_id").join(called, "neuron_id", "left").join(unlabelled_fraction(counts).select("neuron_id", "unlabelled_fraction"), "neuron_id", "left")
    return out.withColumn("reason", F.when(F.col("call").isNull(), "no_labelled_partners")).withColumn("call", F.coalesce("call", F.lit("unknown")))
