"""Zero-shot classification benchmark, calibration and its storage."""

from __future__ import annotations

import dataclasses
import hashlib
import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import hash_uniform
from .calibrate import bootstrap_means, calibration_report, fit_logistic_folds
from .compare import MIN_YARDSTICK, Atlas, LogisticModel, choose_delta, choose_s_floor, partner_counts, partner_labels, truth_labels
from .graph import Graph
from .paths import settle

FEATURES = ("s1", "margin", "log_mass")


def masked_sums(atlas: Atlas, truths: DataFrame) -> DataFrame:
    """(truth, group, dir, label, value) of every group of which a member touches the label ``truth``: the sums of its
    members' profiles with that label masked, each profile normalised anew."""
    groups = atlas.members.withColumnRenamed("label", "group")
    prof = atlas.profiles.join(groups, "neuron_id")
    share = prof.join(truths.select(F.col("truth").alias("label")), "label", "left_semi").select("neuron_id", "dir", F.col("label").alias("truth"), F.col("value").alias("f"))
    # A profile half without a share f grows by f / (1 - f) of itself; without anything left it goes.
    grown = prof.join(share, ["neuron_id", "dir"]).where(F.col("label") != F.col("truth"))
    delta = grown.groupBy("truth", "group", "dir", "label").agg(F.sum(F.col("value") * F.col("f") / (1 - F.col("f"))).alias("delta"))
    touched = share.join(groups, "neuron_id").select("truth", "group").distinct()
    rows = touched.join(atlas.sums, "group").where(F.col("label") != F.col("truth")).join(delta, ["truth", "group", "dir", "label"], "left")
    return rows.select("truth", "group", "dir", "label", (F.col("value") + F.coalesce("delta", F.lit(0.0))).alias("value"))


#: Queries of a type that are scored together, and cells of their matrix by partner labels or groups.
CHUNK, CELLS = 4_000, 2_000_000


def _best(prof: DataFrame, queries: DataFrame, sums: DataFrame, masked: DataFrame, first: Sequence[str], n: int) -> DataFrame:
    """(neuron_id, truth, best): the ``n`` best groups (group, s) of every query by the cosine of its profile ``prof`` to their ``sums``, of
    groups in ``masked`` to those; ties (to ten digits) by group. ``first`` are groups to fill up with at 0.

    The queries of a type are dealt in chunks, which meet the sums of the labels that the type's profiles have. A task scores a chunk
    as a product of two small matrices, so that scores of queries by groups are never rows."""
    square = lambda df, *by: df.groupBy(*by).agg(F.sum(F.col("value") * F.col("value")).alias("gg"))
    used = settle(prof.select("truth", "dir", "label").distinct())
    touched = masked.select("truth", "group").distinct()
    plain = used.join(sums, ["dir", "label"]).join(touched, ["truth", "group"], "left_anti").join(square(sums, "group"), "group")
    other = used.join(masked, ["truth", "dir", "label"]).join(square(masked, "truth", "group"), ["truth", "group"])
    columns = ["truth", "dir", "label", "group", "value", "gg"]
    chunks = queries.groupBy("truth").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("_n"))  # one row a type
    at = F.pmod(F.xxhash64("neuron_id"), F.col("_n")).cast("int").alias("chunk")
    sent = plain.select(columns).unionByName(other.select(columns)).join(chunks, "truth").select(*columns, F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("chunk"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("dir", "string"), ("label", "string"), ("value", "double"))]
    asked = prof.unionByName(queries.select("neuron_id", "truth", *none)).join(F.broadcast(chunks), "truth").select("neuron_id", "truth", "dir", "label", "value", at)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, row = np.unique(left["neuron_id"].to_numpy(), return_inverse=True)
        truth, has = left["truth"][0].as_py(), left["value"].is_valid().to_numpy()
        name = lambda t: pc.binary_join_element_wise(t["dir"], t["label"], "\t")
        labels = pc.unique(name(right))
        column = pc.index_in(name(left), labels).combine_chunks() if len(left) else pa.array([], pa.int32())
        has &= column.is_valid().to_numpy(zero_copy_only=False)
        groups = sorted({*right["group"].unique().to_pylist(), *first}, key=str.encode)
        place = pc.index_in(right["group"], pa.array(groups, pa.string())).to_numpy()
        weight, gg, qq = np.zeros((len(labels), len(groups))), np.zeros(len(groups)), np.zeros(len(ids))
        weight[pc.index_in(name(right), labels).to_numpy(), place] = right["value"].to_numpy()
        gg[place] = right["gg"].to_numpy()
        value = left["value"].fill_null(0.0).to_numpy()
        np.add.at(qq, row, value * value)
        row, value, column = row[has], value[has], column.fill_null(0).to_numpy()[has]
        order, found = np.argsort(row, kind="stable"), []
        row, value, column = row[order], value[order], column[order]
        step = max(1, CELLS // max(1, len(labels), len(groups)))
        for low in range(0, len(ids), step):
            k = min(step, len(ids) - low)
            a, b = np.searchsorted(row, [low, low + k])
            x = np.zeros((k, len(labels)))
            np.add.at(x, (row[a:b] - low, column[a:b]), value[a:b])
            norm = np.sqrt(qq[low : low + k, None]) * np.sqrt(gg)
            s = np.divide(x @ weight, norm, out=np.zeros((k, len(groups))), where=norm > 0)
            top = np.argsort(-np.round(s, 10), axis=1, kind="stable")[:, :n]
            found.append((top, np.take_along_axis(s, top, 1)))
        top, s = (np.concatenate(z) for z in zip(*found, strict=True))
        pairs = pa.StructArray.from_arrays([pa.array(groups, pa.string()).take(pa.array(top.ravel())), pa.array(s.ravel())], ["group", "s"])
        ends = pa.array(np.arange(len(ids) + 1, dtype=np.int32) * top.shape[1])
        return pa.table({"neuron_id": ids, "truth": [truth] * len(ids), "best": pa.ListArray.from_arrays(ends, pairs)})

    def chunk(left: pa.Table, right: pa.Table) -> pa.Table:
        if len(left):
            return score(left, right)
        return pa.table({"neuron_id": pa.array([], pa.int64()), "truth": pa.array([], pa.string()), "best": pa.array([], pa.list_(pa.struct([("group", pa.string()), ("s", pa.float64())])))})

    return asked.groupBy("truth", "chunk").cogroup(sent.groupBy("truth", "chunk")).applyInArrow(chunk, "neuron_id long, truth string, best array<struct<group string, s double>>")


def run_benchmark(query: Graph, atlas: Atlas, *, query_ref: str, truth_column: str = "fafb_783_cell_type", max_types: int = 2000, seed: int = 0, protocols: Sequence[str] = ("closed", "open"), top_k: int = 5) -> DataFrame:
    """Records (query, protocol, level, type, neuron_id, top1, top_labels, s1, a1, margin, correct, top3, empty,
    log_mass) of at most ``max_types`` types, per neuron and (neuron_id -1) per type's mean profile.

    A type's own label is masked on both sides before profiles are normalised; the open protocol also takes the type's
    centroid away. Neurons without any other named partner are records too (``empty``). The type is a column, so all types
    are scored in the same joins."""
    truth = truth_labels(query.nodes, truth_column, atlas.members)
    types = truth.select("truth").distinct().withColumn("_u", hash_uniform(F.lit(seed), F.col("truth"))).orderBy("_u", "truth").limit(max_types).select("truth")
    types = settle(types)
    members = settle(truth.join(F.broadcast(types), "truth", "left_semi").select("neuron_id", "truth"))
    counts = partner_counts(query, partner_labels(query.nodes, atlas.params["vocabulary"])).join(members, "neuron_id").where(F.col("label").isNotNull() & (F.col("label") != F.col("truth")))
    if atlas.params["direction"] != "both":
        counts = counts.where(F.col("dir") == atlas.params["direction"])
    counts = settle(counts.where(~F.col("label").isin(list(atlas.mask))) if atlas.mask else counts)
    total = F.sum("value").over(W.partitionBy("neuron_id", "dir"))
    own = counts.select("neuron_id", "truth", "dir", "label", (F.col("value") / total).alias("value"))
    mass = counts.groupBy("neuron_id").agg(F.log1p(F.sum("value")).alias("log_mass"))
    full = own.select("neuron_id", "truth").distinct()
    size = full.groupBy("truth").agg(F.count("*").alias("n"))
    mean = own.groupBy("truth", "dir", "label").agg(F.sum("value").alias("s")).join(size, "truth").select(F.lit(-1).cast("long").alias("neuron_id"), "truth", "dir", "label", (F.col("s") / F.col("n")).alias("value"))
    prof = settle(own.unionByName(mean))
    queries = members.unionByName(types.select(F.lit(-1).cast("long").alias("neuron_id"), "truth"))
    some = full.unionByName(full.select(F.lit(-1).cast("long").alias("neuron_id"), "truth").distinct()).withColumn("_some", F.lit(True))
    queries = settle(queries.join(some, ["neuron_id", "truth"], "left").select("neuron_id", "truth", F.col("_some").isNull().alias("empty")))
    masked, key = settle(masked_sums(atlas, types)), ["neuron_id", "truth"]
    labels = [r["label"] for r in atlas.members.select("label").distinct().orderBy("label").limit(2 * top_k + 1).collect()]
    best = settle(_best(prof, queries, atlas.sums, masked, labels, top_k + 1))
    yards, out = F.broadcast(atlas.yardsticks.select(F.col("group").alias("top1"), "neuron_yard", "group_yard")), None
    for protocol in protocols:
        ranked = F.col("best") if protocol == "closed" else F.filter("best", lambda x: x["group"] != F.col("truth"))
        r = best.withColumn("r", F.slice(ranked, 1, top_k)).where(F.size("r") > 0).drop("best")
        r = r.join(queries, key).join(mass, "neuron_id", "left")
        top = F.transform("r", lambda x: x["group"])
        s1, s2 = F.col("r")[0]["s"], F.coalesce(F.get("r", F.lit(1))["s"], F.lit(0.0))
        level = F.when(F.col("neuron_id") < 0, "group").otherwise("neuron")
        r = r.select(F.lit(query_ref).alias("query"), F.lit(protocol).alias("protocol"), level.alias("level"), F.col("truth").alias("type"), "neuron_id", top[0].alias("top1"), top.alias("top_labels"), s1.alias("s1"), (s1 - s2).alias("margin"), "empty", F.coalesce("log_mass", F.lit(0.0)).alias("log_mass"))
        yard = F.when(F.col("level") == "group", F.col("group_yard")).otherwise(F.col("neuron_yard"))
        r = r.join(yards, "top1").select("query", "protocol", "level", "type", "neuron_id", "top1", "top_labels", "s1", (F.col("s1") / F.greatest(yard, F.lit(MIN_YARDSTICK))).alias("a1"), "margin", (F.col("top1") == F.col("type")).alias("correct"), F.array_contains(F.slice("top_labels", 1, 3), F.col("type")).alias("top3"), "empty", "log_mass")
        out = r if out is None else out.unionByName(r)
    return out


@dataclass(frozen=True)
class Calibration:
    """A fitted acceptance model with its thresholds, tied to the parameters of an atlas."""

    reference: str
    atlas_hash: str
    model: LogisticModel
    s_floor: float
    delta: float
    accept: float
    metrics: dict

    @property
    def id(self) -> str:
        return hashlib.sha256(self.to_json().encode()).hexdigest()[:12]

    def to_json(self) -> str:
        return json.dumps(dataclasses.asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Calibration:
        d = json.loads(text)
        m = d.pop("model")
        return cls(model=LogisticModel(tuple(m["features"]), tuple(m["coef"]), m["intercept"]), **d)

    def save(self, path: str) -> None:
        Path(path).write_text(self.to_json())

    def incompatible_with(self, atlas: Atlas) -> str | None:
        return None if self.atlas_hash == atlas.hash else f"calibrated for atlas {self.atlas_hash}, not {atlas.hash}"


#: Feature sets whose out-of-fold errors are reported beside those of the model.
VARIANTS = {"model": FEATURES, "score": ("s1",), "score_margin": ("s1", "margin")}


def fit_calibration(records: DataFrame, atlas: Atlas, *, reference: str, level: str = "neuron", n_folds: int = 5, seed: int = 0, accept: float = 0.8, max_false_accept: float = 0.10, n_boot: int = 1000, variants: Mapping[str, Sequence[str]] = VARIANTS) -> Calibration:
    """Acceptance model of all records and, by type-level folds, what it is worth: errors, coverage and accuracy of closed
    records and false accepts of open ones, where neither the model nor the thresholds of a row have seen its type.

    ``records`` are a benchmark's (settled) rows; queries without partners (``empty``) are left out. All is done by aggregates;
    the driver holds coefficients and metrics alone."""
    rows = records.where((F.col("level") == level) & ~F.col("empty"))
    closed, opened = settle(rows.where("protocol = 'closed'")), settle(rows.where("protocol = 'open'"))
    models = fit_logistic_folds(closed, FEATURES, "correct")
    if -1 not in models:
        raise ValueError("both outcomes are needed")
    top1 = bootstrap_means(closed.withColumn("r", F.col("correct").cast("double")), "type", "r", n_boot=n_boot, seed=seed).first()
    report = {r["variant"]: r.asDict() for r in calibration_report(closed, opened, variants, n_folds=n_folds, seed=seed, accept=accept, max_false_accept=max_false_accept).collect()}
    metrics = {"n": top1["n"], "top1": (top1["mean"], top1["ci_low"], top1["ci_high"]), "variants": report}
    floor = choose_s_floor(opened, max_false_accept=max_false_accept)
    delta = choose_delta(closed.withColumn("right", F.col("correct")))
    return Calibration(reference, atlas.hash, models[-1], floor, delta, accept, metrics)


def write_benchmark(records: DataFrame, calibration: Calibration, out: str) -> None:
    """Records as Parquet by query, and the metrics."""
    records.write.mode("overwrite").partitionBy("query").parquet(f"{out}/records.parquet")
    records.sparkSession.createDataFrame([(json.dumps(calibration.metrics),)], "metrics string").coalesce(1).write.mode("overwrite").text(f"{out}/metrics.json")
