"""Converters from released connectome files to harmonised tables, as DataFrame plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import normalize_nt, normalize_side, normalize_super_class, tokens
from ..schema import NT_CLASSES, conform_edges, conform_neurons


def first_rows(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the first in ``order``."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(order))).where("_r = 1").drop("_r")


def sum_rois(rows: DataFrame) -> DataFrame:
    """(pre, post, weight, n_rois): weights summed over neuropils, before any threshold."""
    return rows.groupBy("pre", "post").agg(F.sum("weight").cast("int").alias("weight"), F.count("*").alias("n_rois"))


def mean_by_body(points: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Means of columns per body as floats, with the number of points; sums are in double."""
    return points.groupBy("body").agg(*(F.avg(F.col(c).cast("double")).cast("float").alias(c) for c in columns), F.count("*").alias("n_presynapses"))


def within(edges: DataFrame, neurons: DataFrame) -> DataFrame:
    """Edges with both ends among the neurons."""
    ids = neurons.select("neuron_id")
    return edges.join(ids.withColumnRenamed("neuron_id", "pre"), "pre", "left_semi").join(ids.withColumnRenamed("neuron_id", "post"), "post", "left_semi")


def synapse_totals(neurons: DataFrame, edges: DataFrame) -> DataFrame:
    """``neurons`` with input and output totals over all partners and over neuron partners only; 0 where none."""
    inside = neurons.select(F.col("neuron_id").alias("_id"))
    out = neurons
    for side, own, other in (("input", "post", "pre"), ("output", "pre", "post")):
        total = edges.groupBy(own).agg(F.sum("weight").alias(f"{side}_synapses_total"))
        known = edges.join(inside.withColumnRenamed("_id", other), other, "left_semi").groupBy(own).agg(F.sum("weight").alias(f"{side}_synapses_neurons"))
        for t, c in ((total, f"{side}_synapses_total"), (known, f"{side}_synapses_neurons")):
            out = out.join(t.withColumnRenamed(own, "neuron_id"), "neuron_id", "left").withColumn(c, F.coalesce(c, F.lit(0)).cast("long"))
    return out


def _tag(df: DataFrame, dataset: str, version: str) -> DataFrame:
    return df.withColumns({"dataset": F.lit(dataset), "version": F.lit(version)})


def _blank(c: str) -> Column:
    return F.nullif(F.trim(F.col(c)), F.lit(""))


def convert_malecns(annotations: DataFrame, transmitters: DataFrame, weights: DataFrame, nt_points: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Bodies with a superclass; nt_pred is the consensus label and nt_conf the confidence of the body's or else
    the type's own label where it equals the consensus. Null labels never equal one."""
    nt = transmitters.select(
        "body",
        normalize_nt(F.col("consensus_nt")).alias("nt_pred"),
        normalize_nt(F.col("predicted_nt")).alias("_body"),
        normalize_nt(F.col("celltype_predicted_nt")).alias("_type"),
        F.col("predicted_nt_confidence").cast("double").alias("_bc"),
        F.col("celltype_predicted_nt_confidence").cast("double").alias("_tc"),
        normalize_nt(F.col("ground_truth")).alias("nt_known"),
    )
    a = annotations.where(F.col("superclass").isNotNull()).join(nt, F.col("bodyId") == F.col("body"), "left")
    conf = F.when(F.col("nt_pred") == F.col("_body"), F.col("_bc")).when(F.col("nt_pred") == F.col("_type"), F.col("_tc"))
    n = a.select(
        F.col("bodyId").cast("long").alias("neuron_id"),
        F.coalesce("statusLabel", "status").alias("status"),
        normalize_super_class("malecns", F.col("superclass")).alias("super_class"),
        F.col("superclass").alias("super_class_raw"),
        _blank("class").alias("cell_class"),
        _blank("subclass").alias("cell_sub_class"),
        _blank("type").alias("cell_type"),
        _blank("itoleeHl").alias("hemilineage"),
        _blank("trumanHl").alias("hemilineage_truman"),
        normalize_side(F.col("somaSide")).alias("side"),
        F.col("somaNeuromere").alias("soma_neuromere"),
        "nt_pred",
        conf.alias("nt_conf"),
        F.lit("consensus").alias("nt_source"),
        "nt_known",
        _blank("flywireType").alias("fafb_783_cell_type"),
        _blank("hemibrainType").alias("hemibrain_121_cell_type"),
        _blank("mancType").alias("manc_121_cell_type"),
        F.col("dimorphism"),
        F.col("vfbId").alias("vfb_id"),
    )
    e = weights.select(F.col("body_pre").cast("long").alias("pre"), F.col("body_post").cast("long").alias("post"), F.col("weight").cast("int").alias("weight"))
    n = synapse_totals(n, e)
    if nt_points is not None:
        cols = [c for c in nt_points.columns if c.startswith("nt_") and c.endswith("_prob")]
        means = mean_by_body(nt_points, cols).withColumnsRenamed({"body": "neuron_id", "n_presynapses": "nt_presynapses"} | {c: "nt_p_" + c[3:-5] for c in cols})
        n = n.join(means, "neuron_id", "left").withColumn("nt_source", F.when(F.col("nt_presynapses").isNotNull(), "presynapses").otherwise(F.col("nt_source")))
    return conform_neurons(_tag(n, "malecns", "1.0")), conform_edges(_tag(within(e, n), "malecns", "1.0"))


def convert_flywire(neurons: DataFrame, classification: DataFrame, types: DataFrame, connections: DataFrame, *, version: str = "783", order: str = "_row") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Neurons, edges and per-neuropil edges; the first row of a repeated id counts (``order`` has the file
    position); edges are summed over neuropils before any threshold."""
    c, t = first_rows(classification, "root_id", order).drop(order), first_rows(types, "root_id", order).drop(order)
    t = t.select("root_id", F.coalesce(_blank("cell_type"), _blank("hemibrain_type")).alias("cell_type"), _blank("hemibrain_type").alias("hemibrain_121_cell_type"))
    p = {"acetylcholine": "ach_avg", "glutamate": "glut_avg", "gaba": "gaba_avg", "dopamine": "da_avg", "octopamine": "oct_avg", "serotonin": "ser_avg"}
    n = neurons.join(c.drop("cell_type"), "root_id", "left").join(t, "root_id", "left").select(
        F.col("root_id").cast("long").alias("neuron_id"),
        F.col("flow"),
        normalize_super_class("codex_fafb", F.col("super_class")).alias("super_class"),
        F.col("super_class").alias("super_class_raw"),
        F.col("class").alias("cell_class"),
        F.col("sub_class").alias("cell_sub_class"),
        "cell_type",
        F.col("hemilineage"),
        normalize_side(F.col("side")).alias("side"),
        normalize_nt(F.col("nt_type")).alias("nt_pred"),
        F.col("nt_type_score").cast("double").alias("nt_conf"),
        *(F.col(v).cast("float").alias(f"nt_p_{k}") for k, v in p.items()),
        F.col("cell_type").alias("fafb_783_cell_type"),
        "hemibrain_121_cell_type",
    )
    roi = connections.select(F.col("pre_root_id").cast("long").alias("pre"), F.col("post_root_id").cast("long").alias("post"), F.col("syn_count").cast("int").alias("weight"), F.col("neuropil").alias("roi"))
    tag = lambda d: _tag(d, "flywire", version)
    return conform_neurons(tag(n)), conform_edges(tag(sum_rois(roi).drop("n_rois"))), conform_edges(tag(roi))


def convert_banc(meta: DataFrame, edgelist: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Proofread segments that are not glia, trachea or non-neurons (no class passes); string ids become longs;
    ``auto:`` matches are stripped and flagged; autapses are dropped; released totals are kept per neuron."""
    is_true = lambda c: F.coalesce(F.col(c) == "TRUE", F.lit(False))
    kept = meta.where((is_true("proofread") | is_true("roughly_proofread")) & ~F.coalesce(F.col("super_class").isin("glia", "trachea", "not_a_neuron"), F.lit(False)))
    n = kept.select(
        F.expr("try_cast(root_id as bigint)").alias("neuron_id"),
        normalize_super_class("banc", F.col("super_class")).alias("super_class"),
        F.col("super_class").alias("super_class_raw"),
        "cell_class",
        "cell_sub_class",
        _blank("cell_type").alias("cell_type"),
        normalize_side(F.col("side")).alias("side"),
        "hemilineage",
        "flow",
        "region",
        normalize_nt(F.col("neurotransmitter_predicted")).alias("nt_pred"),
        F.expr("try_cast(neurotransmitter_score as double)").alias("nt_conf"),
        _blank("fafb_cell_type").alias("fafb_783_cell_type"),
        _blank("manc_cell_type").alias("manc_121_cell_type"),
        _blank("malecns_cell_type").alias("malecns_09_cell_type"),
        F.regexp_replace(_blank("hemibrain_cell_type"), "^auto:", "").alias("hemibrain_121_cell_type"),
        F.coalesce(F.startswith(_blank("hemibrain_cell_type"), F.lit("auto:")), F.lit(False)).alias("hemibrain_121_match_auto"),
        F.col("sexually_dimorphic").alias("dimorphism"),
    )
    e = edgelist.select(F.col("pre").cast("long").alias("pre"), F.col("post").cast("long").alias("post"), F.col("count").cast("int").alias("weight"), "post_count", "pre_count").where("pre <> post")
    into = e.groupBy(F.col("post").alias("neuron_id")).agg(F.max(F.col("post_count").cast("long")).alias("input_synapses_total"))
    outof = e.groupBy(F.col("pre").alias("neuron_id")).agg(F.max(F.col("pre_count").cast("long")).alias("output_synapses_total"))
    n = n.join(into, "neuron_id", "left").join(outof, "neuron_id", "left").fillna(0, ["input_synapses_total", "output_synapses_total"])
    return conform_neurons(_tag(n, "banc", "888")), conform_edges(_tag(within(e.select("pre", "post", "weight"), n), "banc", "888"))


def convert_hemibrain(traced: DataFrame, connections: DataFrame, meta: DataFrame | None = None, transmitters: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Traced neurons with optional annotations; nt_conf is the greatest of the class probabilities."""
    n = traced.select(F.col("bodyId").cast("long").alias("neuron_id"), _blank("type").alias("cell_type"), F.col("instance"))
    if meta is not None:
        m = meta.select(F.col("bodyId").cast("long").alias("neuron_id"), normalize_side(F.col("side")).alias("side"), "hemilineage", normalize_super_class("sjcabs", F.col("super_class")).alias("super_class"))
        n = n.join(m, "neuron_id", "left")
    if transmitters is not None:
        have = [c for c in (*NT_CLASSES, "neither") if c in transmitters.columns]
        t = transmitters.select(F.col("body").cast("long").alias("neuron_id"), normalize_nt(F.col("predicted_nt")).alias("nt_pred"), *(F.col(c).cast("float").alias(f"nt_p_{c}") for c in have), F.greatest(*(F.col(c).cast("double") for c in have)).alias("nt_conf"))
        n = n.join(t, "neuron_id", "left")
    e = connections.select(F.col("bodyId_pre").cast("long").alias("pre"), F.col("bodyId_post").cast("long").alias("post"), F.col("weight").cast("int").alias("weight")).where("pre <> post")
    n = n.withColumn("hemibrain_121_cell_type", F.col("cell_type"))
    return conform_neurons(_tag(n, "hemibrain", "1.2.1")), conform_edges(_tag(within(e, n), "hemibrain", "1.2.1"))


def convert_manc(meta: DataFrame, edgelist: DataFrame, codex: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """All rows of the meta table; the Codex confidence counts only where labels agree; totals include autapses
    and partners outside, edges do not."""
    n = meta.select(
        F.col("bodyId").cast("long").alias("neuron_id"),
        normalize_super_class("manc", F.col("super_class")).alias("super_class"),
        F.col("super_class").alias("super_class_raw"),
        _blank("cell_type").alias("cell_type"),
        _blank("cell_type").alias("manc_121_cell_type"),
        normalize_side(F.col("side")).alias("side"),
        F.col("hemilineage"),
        F.col("nerve"),
        normalize_nt(F.col("neurotransmitter_predicted")).alias("nt_pred"),
    )
    if codex is not None:
        c = codex.select(F.col("root_id").cast("long").alias("neuron_id"), normalize_nt(F.col("nt")).alias("_nt"), F.col("nt_confidence").cast("double").alias("_c"), F.nullif(F.regexp_extract("labels", r"vfbId::([^,]+)", 1), F.lit("")).alias("vfb_id"))
        n = n.join(c, "neuron_id", "left").withColumn("nt_conf", F.when(F.col("nt_pred") == F.col("_nt"), F.col("_c"))).drop("_nt", "_c")
    e = edgelist.select(F.col("pre").cast("long").alias("pre"), F.col("post").cast("long").alias("post"), F.col("count").cast("int").alias("weight"), "total_input")
    into = e.groupBy(F.col("post").alias("neuron_id")).agg(F.max(F.col("total_input").cast("long")).alias("input_synapses_total"))
    outof = e.groupBy(F.col("pre").alias("neuron_id")).agg(F.sum("weight").alias("output_synapses_total"))
    n = n.join(into, "neuron_id", "left").join(outof, "neuron_id", "left").fillna(0, ["input_synapses_total", "output_synapses_total"])
    return conform_neurons(_tag(n, "manc", "1.2.1")), conform_edges(_tag(within(e.where("pre <> post").select("pre", "post", "weight"), n), "manc", "1.2.1"))


def convert_shiu(completeness: DataFrame, connectivity: DataFrame, *, version: str = "630") -> tuple[DataFrame, DataFrame]:
    """Signs of edges are constant per neuron; a placeholder transmitter carries them."""
    e = connectivity.select(F.col("Presynaptic_ID").cast("long").alias("pre"), F.col("Postsynaptic_ID").cast("long").alias("post"), F.col("Connectivity").cast("int").alias("weight"), F.col("Excitatory").cast("byte").alias("sign"))
    sign = e.groupBy(F.col("pre").alias("neuron_id")).agg(F.max("sign").alias("_s"))
    n = completeness.select(F.col(completeness.columns[0]).cast("long").alias("neuron_id")).join(sign, "neuron_id", "left")
    nt = F.when(F.col("_s") > 0, "acetylcholine").when(F.col("_s") < 0, "gaba")
    n = n.select("neuron_id", nt.alias("nt_pred"), F.when(nt.isNotNull(), F.lit(1.0)).alias("nt_conf"))
    return conform_neurons(_tag(n, "shiu", version)), conform_edges(_tag(e, "shiu", version)).orderBy("pre", "post")


def convert_lines(lines: DataFrame) -> DataFrame:
    """Driver lines (line, cell_types and em_ids as token lists, quality) with arrays and counts."""
    types, ids = tokens(F.col("cell_types"), ",;"), F.filter(tokens(F.col("em_ids"), ",;"), lambda x: x.rlike("^[0-9]+$"))
    return lines.select("line", "quality", types.alias("cell_types"), F.transform(ids, lambda x: x.cast("long")).alias("em_body_ids"), F.size(types).alias("n_types"), F.size(ids).alias("n_bodies"))
