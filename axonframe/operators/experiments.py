"""Silencing and stimulation experiments, sweeps and robustness screens from specifications."""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import paths as path_ops
from . import stats
from .graph import SAMPLED, Graph, build_graph, has_nt_probabilities
from .nulls import degree_preserving_rewire, shuffle_signs
from .sim import Condition, LIFParams, conditions_summary, group_rates, params_for, rates_table, simulate
from .spec import Controls, ExperimentSpec, Report, Robustness, Selection, Stimulus, Sweep, load_spec, spec_from_dict

NO_CONTROLS = Controls(0, 0, False)


@dataclass
class Context:
    """A prepared experiment: graph, driven rates, readout members, parameters."""

    spec: ExperimentSpec
    neurons: DataFrame
    edges: DataFrame
    graph: Graph
    rates: dict[int, float]
    readouts: dict[str, list[int]]
    params: LIFParams
    seconds: float = field(init=False)

    def __post_init__(self) -> None:
        self.seconds = self.spec.n_steps * self.params.dt / 1000

    @property
    def members(self) -> DataFrame:
        return self.graph.spark.createDataFrame([(k, i) for k, v in self.readouts.items() for i in v], "label string, neuron_id long")


def drive(neurons: DataFrame, stimuli: Sequence[Stimulus]) -> dict[int, float]:
    """Rate of each driven neuron; later stimuli win."""
    rates: dict[int, float] = {}
    for s in stimuli:
        rates |= dict.fromkeys(s.select.resolve(neurons), s.rate_hz)
    return rates


def prepare(spec: ExperimentSpec, neurons: DataFrame, edges: DataFrame) -> Context:
    """Resolve selections and build the graph; sampled signs without probabilities are refused."""
    if spec.sign_policy == SAMPLED and not has_nt_probabilities(neurons):
        raise ValueError("sampled signs need transmitter probabilities")
    neurons = path_ops.settle(neurons)
    graph = build_graph(neurons, edges, min_weight=spec.min_weight, sign_policy=spec.sign_policy, seed=spec.sign_seed, provenance={"dataset": spec.dataset})
    params = params_for(spec.dataset)
    if spec.w_syn_mv is not None:
        params = dataclasses.replace(params, w_syn=spec.w_syn_mv)
    return Context(spec, neurons, edges, path_ops.settled(graph), drive(neurons, spec.stimulate), {k: v.resolve(neurons) for k, v in spec.readouts.items()}, params)


def refuse_used(spark: SparkSession, out_dir: str) -> None:
    """An error if the folder holds anything already."""
    path = spark._jvm.org.apache.hadoop.fs.Path(out_dir)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(path) and len(fs.listStatus(path)):
        raise FileExistsError(f"{out_dir} is not empty")


def _split(counts: DataFrame) -> DataFrame:
    """Condition names ``condition|control|replicate`` as three columns."""
    part = F.split("condition", r"\|")
    return counts.select(part[0].alias("condition"), F.coalesce(F.get(part, F.lit(1)), F.lit("none")).alias("control"), F.coalesce(F.get(part, F.lit(2)).cast("int"), F.lit(0)).alias("replicate"), "trial", "neuron_id", "count")


def shared_runs(c: Context) -> DataFrame:
    """Counts (condition, control, replicate, trial, neuron_id, count) of the baseline, stimulated and perturbed runs, and
    of the stimulated run on null graphs."""
    s = c.spec
    run = lambda g, conditions: simulate(g, conditions, n_trials=s.trials, n_steps=s.n_steps, params=c.params)
    own = [Condition("baseline", {}, seed=s.seed)] if s.controls.unstimulated_baseline else []
    own.append(Condition("stimulated", c.rates, seed=s.seed))
    if s.perturbed:
        silent = tuple(sorted({i for x in s.silence for i in x.resolve(c.neurons)}))
        own.append(Condition("perturbed", c.rates | drive(c.neurons, s.perturb_stimulate), silent, seed=s.seed))
    out = run(c.graph, own)
    for k in range(s.controls.degree_preserving_rewire):
        out = out.unionByName(run(degree_preserving_rewire(c.graph, s.seed + 1000 + k), [Condition(f"stimulated|degree_preserving_rewire|{k}", c.rates, seed=s.seed)]))
    for k in range(s.controls.sign_shuffle):
        out = out.unionByName(run(shuffle_signs(c.graph, s.seed + 2000 + k), [Condition(f"stimulated|sign_shuffle|{k}", c.rates, seed=s.seed)]))
    return path_ops.settle(_split(out))


def comparisons(spec: ExperimentSpec) -> list[tuple[str, tuple[str, str], tuple[str, str]]]:
    """(name, test run, control run) of an experiment, runs as (condition, control)."""
    stimulated = ("stimulated", "none")
    out = [("perturbed_vs_stimulated", ("perturbed", "none"), stimulated)] if spec.perturbed else []
    out += [("stimulated_vs_baseline", stimulated, ("baseline", "none"))] if spec.controls.unstimulated_baseline else []
    return out + [(f"stimulated_vs_{k}", stimulated, ("stimulated", k)) for k in ("degree_preserving_rewire", "sign_shuffle") if getattr(spec.controls, k)]


def run_rates(c: Context, counts: DataFrame) -> DataFrame:
    """(condition, control, replicate, readout, n_neurons, trial, hz) of the readouts, runs without spikes too."""
    s, spark = c.spec, c.graph.spark
    runs = [(x, y, 0) for x, y in {r for _, a, b in comparisons(s) for r in (a, b) if r[1] == "none"} | {("stimulated", "none")}]
    runs += [("stimulated", k, i) for k in ("degree_preserving_rewire", "sign_shuffle") for i in range(getattr(s.controls, k))]
    keys, members = ["condition", "control", "replicate"], c.members
    size = members.groupBy("label").agg(F.count("*").alias("n_neurons"))
    grid = spark.createDataFrame(runs, "condition string, control string, replicate int").join(F.broadcast(size)).withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(s.trials - 1))))
    got = counts.join(members, "neuron_id").groupBy(*keys, "label", "trial").agg(F.sum("count").alias("s"))
    return grid.join(got, [*keys, "label", "trial"], "left").select(*keys, F.col("label").alias("readout"), "n_neurons", "trial", (F.coalesce("s", F.lit(0)) / F.col("n_neurons") / c.seconds).alias("hz"))


_EFFECT = "mean_test double, mean_control double, difference double, ci_low double, ci_high double, p_value double, cohens_d double, n_test long, n_control long"


def compare_runs(rows: DataFrame, by: Sequence[str], *, seed: int, alpha: float, paired: bool = False) -> DataFrame:
    """Effects of each group of ``by`` from (by, test: boolean, trial, hz): a group per task, q-values over all."""
    import pandas as pd

    def one(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("trial")
        a, b = f.loc[f["test"], "hz"], f.loc[~f["test"], "hz"]
        r = (stats.compare_paired if paired else stats.compare_groups)(a, b, seed=seed)
        row = dict(zip(by, key, strict=True)) | {"mean_test": r["mean_a"], "mean_control": r["mean_b"], "n_test": len(a), "n_control": len(b)}
        return pd.DataFrame([row | {k: r[k] for k in ("difference", "ci_low", "ci_high", "p_value", "cohens_d")}])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*by).schema)
    found = stats.bh_qvalues(rows.groupBy(*by).applyInPandas(one, f"{kinds}, {_EFFECT}"))
    return found.withColumn("significant", F.coalesce(F.col("q_value") < alpha, F.lit(False)))


def readout_stats(c: Context, rates: DataFrame) -> DataFrame:
    """readout, n_neurons, comparison, means, difference with interval, p, effect size, sizes, q_value, significant."""
    parts = []
    for name, test, control in comparisons(c.spec):
        pick = lambda r: (F.col("condition") == r[0]) & (F.col("control") == r[1])
        parts += [rates.where(pick(r)).select("readout", "n_neurons", F.lit(name).alias("comparison"), F.lit(t).alias("test"), "trial", "hz") for r, t in ((test, True), (control, False))]
    rows = parts[0]
    for x in parts[1:]:
        rows = rows.unionByName(x)
    return compare_runs(rows, ["readout", "n_neurons", "comparison"], seed=c.spec.seed, alpha=c.spec.report.alpha)


def top_neurons(c: Context, counts: DataFrame) -> DataFrame:
    """The ``report.top_neurons`` most active neurons of each condition."""
    own = rates_table(counts.where("control = 'none'"), c.graph.nodes, n_trials=c.spec.trials, seconds=c.seconds)
    order = W.partitionBy("condition").orderBy(F.desc("rate_hz_mean"), "neuron_id")
    return own.where("spiked_in_any_trial").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= c.spec.report.top_neurons).orderBy("condition", "rank")


def run_experiment(spec: ExperimentSpec, neurons: DataFrame, edges: DataFrame, out_dir: str | None = None) -> dict[str, DataFrame]:
    """Run one experiment; tables are returned and, with ``out_dir`` (which must be empty), written as Parquet."""
    if spec.sweep is not None:
        raise ValueError("a sweep is run with run_sweep")
    if out_dir:
        refuse_used(neurons.sparkSession, out_dir)
    c = prepare(spec, neurons, edges)
    counts = shared_runs(c)
    rates = path_ops.settle(run_rates(c, counts))
    found = {"counts": counts, "conditions": _conditions(counts), "readout_rates": rates, "readouts": readout_stats(c, rates), "top_neurons": top_neurons(c, counts)}
    if out_dir:
        write_tables(found, out_dir, spec)
    return found


def _conditions(counts: DataFrame) -> DataFrame:
    """(condition, control, replicate, total_spikes, active_neurons) of every run with a spike."""
    return counts.groupBy("condition", "control", "replicate").agg(F.sum("count").alias("total_spikes"), F.countDistinct("neuron_id").alias("active_neurons"))


def write_tables(tables: Mapping[str, DataFrame], out_dir: str, spec: ExperimentSpec) -> None:
    """Each table as a Parquet folder; ``done`` (one row with the spec's hash) last, so that runs can resume."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{out_dir}/{name}.parquet")
    first = next(iter(tables.values()))
    first.sparkSession.createDataFrame([(spec.name, spec.sha256)], "name string, sha256 string").coalesce(1).write.mode("overwrite").json(f"{out_dir}/done.json")


def is_done(spark: SparkSession, out_dir: str, spec: ExperimentSpec) -> bool:
    try:
        row = spark.read.json(f"{out_dir}/done.json").first()
    except Exception:  # noqa: BLE001  no marker: not done
        return False
    return row is not None and row["sha256"] == spec.sha256


def _selected(c: Context, select: Selection) -> DataFrame:
    """(neuron_id, label) of a selection by the sweep's grouping, without the driven and the read neurons."""
    from .access import selected

    used = {*c.rates, *(i for v in c.readouts.values() for i in v)}
    drop = c.graph.spark.createDataFrame([(int(i),) for i in used], "neuron_id long")
    rows = selected(c.neurons, ids=select.ids, globs={k: v for k in ("cell_type", "super_class", "cell_class", "side") if (v := getattr(select, k)) is not None})
    return rows.where(F.col(c.spec.sweep.group_by).isNotNull()).select("neuron_id", F.col(c.spec.sweep.group_by).cast("string").alias("label")).join(drop, "neuron_id", "left_anti")


def candidate_groups(c: Context, counts: DataFrame) -> DataFrame:
    """(label, score, reason): groups to silence, ranked by activity in the stimulated run or by pathway score;
    reason is null for the first ``max_items`` eligible ones."""
    w = c.spec.sweep
    if w.rank_by == "pathway":
        found = path_ops.find_paths(c.graph, sorted(c.rates), c.readouts[w.pathway.readout], max_hops=w.pathway.max_hops, min_weight=w.pathway.min_weight, min_edge_fraction=w.pathway.min_edge_fraction)
        per = stats.pathway_scores(found).select("neuron_id", "score")
    else:
        per = counts.where("condition = 'stimulated' and control = 'none'").groupBy("neuron_id").agg((F.sum("count") / c.spec.trials / c.seconds).alias("score"))
    scored = _selected(c, w.select).join(per, "neuron_id", "left").groupBy("label").agg(F.sum(F.coalesce("score", F.lit(0.0))).alias("score"))
    out = stats.running_eligible(scored, "score", "label", F.col("score") > 0, w.max_items)
    reason = F.when(F.col("score") <= 0, "not on a path" if w.rank_by == "pathway" else "inactive").when(~F.col("taken"), "beyond max_items")
    return out.select("label", "score", reason.alias("reason"))


def off_route_controls(c: Context, counts: DataFrame, n: int) -> list[str]:
    """Active groups without a member on any path from the stimulus to the readouts, the most active first."""
    w = c.spec.sweep
    near = path_ops.nodes_on_paths(c.graph, sorted(c.rates), sorted({i for v in c.readouts.values() for i in v}), max_hops=w.pathway.max_hops if w.pathway else 3)
    groups = c.neurons.select("neuron_id", F.col(w.group_by).cast("string").alias("label")).where("label is not null")
    on = groups.join(near, "neuron_id", "left_semi").select("label").distinct()
    active = groups.join(counts.where("condition = 'stimulated' and control = 'none'"), "neuron_id").groupBy("label").agg((F.sum("count") / c.spec.trials / c.seconds).alias("hz")).where("hz >= 1")
    return [r["label"] for r in active.join(on, "label", "left_anti").orderBy(F.desc("hz"), "label").limit(n).collect()]


def run_sweep(spec: ExperimentSpec, neurons: DataFrame, edges: DataFrame, out_dir: str | None = None, *, extra: Sequence[Selection] = (), n_off_route: int = 0) -> dict[str, DataFrame]:
    """Silence each candidate group (or take each rate) in one simulation job and compare with the stimulated run (of a
    rate sweep: with the first rate). ``extra`` selections and ``n_off_route`` groups that are on no route are
    controls."""
    if spec.sweep is None:
        raise ValueError("the specification has no sweep")
    if out_dir:
        refuse_used(neurons.sparkSession, out_dir)
    c, w = prepare(spec, neurons, edges), spec.sweep
    shared, spark = shared_runs(c), c.graph.spark
    if w.kind == "rate_hz":
        names = [(f"{r:g} Hz", "candidate", 0, float(r)) for r in w.rates_hz]
        conditions = [Condition(f"{r:g} Hz", dict.fromkeys(c.rates, r), seed=spec.seed) for r in w.rates_hz]
        reference, candidates = names[0][0], spark.createDataFrame([(n[0], None, None) for n in names], "label string, score double, reason string")
    else:
        reference, candidates = "stimulated", path_ops.settle(candidate_groups(c, shared))
        chosen = [r["label"] for r in candidates.where("reason is null").orderBy(F.desc("score"), "label").collect()]
        others = [x for x in off_route_controls(c, shared, n_off_route) if x not in chosen] if n_off_route else []
        labels = spark.createDataFrame([(x,) for x in (*chosen, *others)], "label string")
        ids = c.neurons.select("neuron_id", F.col(w.group_by).cast("string").alias("label")).join(F.broadcast(labels), "label", "left_semi")
        by = {r["label"]: tuple(r["ids"]) for r in ids.groupBy("label").agg(F.sort_array(F.collect_list("neuron_id")).alias("ids")).collect()}
        by |= {x.describe(): tuple(x.resolve(c.neurons)) for x in extra}
        roles = [(x, "candidate") for x in chosen] + [(x, "off_route") for x in others] + [(x.describe(), "extra") for x in extra]
        names = [(x, role, len(by[x]), None) for x, role in roles]
        conditions = [Condition(x, c.rates, by[x], seed=spec.seed) for x, _ in roles]
    variants = spark.createDataFrame(names, "variant string, role string, n_silenced int, rate_hz double")
    both = shared.where("condition = 'stimulated' and control = 'none'").select("condition", "trial", "neuron_id", "count")
    if conditions:
        both = path_ops.settle(both.unionByName(simulate(c.graph, conditions, n_trials=spec.trials, n_steps=spec.n_steps, params=c.params)))
    # A variant without any spike has no rows; it is a condition all the same.
    every = variants.select(F.col("variant").alias("condition")).unionByName(spark.createDataFrame([("stimulated",)], "condition string")).distinct()
    silent = every.join(both.select("condition").distinct(), "condition", "left_anti").select("condition", F.lit(0).alias("trial"), F.lit(-1).cast("long").alias("neuron_id"), F.lit(0).cast("long").alias("count"))
    size = c.members.groupBy(F.col("label").alias("readout")).agg(F.count("*").alias("n_neurons"))
    rates = path_ops.settle(group_rates(both.unionByName(silent), c.members, n_trials=spec.trials, seconds=c.seconds).withColumnRenamed("label", "readout"))
    test = rates.where(F.col("condition") != reference).where(F.col("condition") != "stimulated") if reference != "stimulated" else rates.where("condition <> 'stimulated'")
    control = rates.where(F.col("condition") == reference).select("readout", "trial", "hz")
    pairs = test.select(F.col("condition").alias("variant"), "readout", F.lit(True).alias("test"), "trial", "hz")
    pairs = pairs.unionByName(control.join(F.broadcast(variants.where(F.col("variant") != reference).select("variant"))).select("variant", "readout", F.lit(False).alias("test"), "trial", "hz"))
    effects = compare_runs(pairs, ["variant", "readout"], seed=spec.seed, alpha=spec.report.alpha, paired=spec.report.statistics == "paired")
    error = F.coalesce(F.stddev_samp("hz"), F.lit(0.0)) / F.sqrt(F.count("*"))
    own = test.groupBy(F.col("condition").alias("variant"), "readout").agg((F.avg("hz") - 1.96 * error).alias("mean_ci_low"), (F.avg("hz") + 1.96 * error).alias("mean_ci_high"))
    alone = c.neurons.select("neuron_id", F.col(w.group_by).cast("string").alias("variant"))
    driven = both.where("condition = 'stimulated'").join(alone, "neuron_id").groupBy("variant").agg((F.sum("count") / spec.trials / c.seconds).alias("stimulated_rate_hz"))
    table = effects.join(variants, "variant").join(own, ["variant", "readout"]).join(size, "readout").join(driven, "variant", "left")
    table = table.select(
        F.lit(w.kind).alias("sweep_kind"), "variant", "n_silenced", "role", F.coalesce("stimulated_rate_hz", F.lit(0.0)).alias("stimulated_rate_hz"), "rate_hz", "readout", "n_neurons", F.col("mean_test").alias("mean_hz"), "mean_ci_low", "mean_ci_high", F.lit(reference).alias("reference"),
        F.col("mean_control").alias("mean_reference_hz"), "difference", "ci_low", "ci_high", "cohens_d", "p_value", F.col("n_test").alias("n_trials"), F.col("n_control").alias("n_trials_reference"), "q_value", "significant",
    )
    table = stats.rank_within(table, "readout", "difference", "variant")
    found = {"variants": candidates, "readout_rates": rates, "sweep": table, "conditions": conditions_summary(both)}
    if out_dir:
        write_tables(found, out_dir, spec)
    return found


def w_syn_values(spec: ExperimentSpec, auto: Sequence[float] | None = None) -> list[float]:
    """Values of the synaptic-weight axis without the reference; ``auto`` are the limits that a calibration of the
    dataset gives (``sim.select_w_syn``)."""
    asked = spec.robustness.w_syn if spec.robustness else "off"
    if asked == "off":
        return []
    if asked == "auto":
        if not auto:
            raise ValueError(f"w_syn: auto needs a calibration of {spec.dataset}; give values in mV, or off")
        asked = auto
    reference = spec.w_syn_mv or params_for(spec.dataset).w_syn
    return sorted({round(float(v), 6) for v in asked} - {round(reference, 6)})


def plan_variants(spec: ExperimentSpec, *, auto_w_syn: Sequence[float] | None = None, probabilities: bool = True) -> list[tuple[str, str, ExperimentSpec]]:
    """(axis, name, spec): the reference and one change at a time; variants run without shared controls."""
    if spec.robustness is None:
        raise ValueError("the specification has no robustness block")
    r, base = spec.robustness, dataclasses.replace(spec, robustness=None)
    change = lambda **new: dataclasses.replace(base, controls=NO_CONTROLS, **new)
    out = [("reference", "reference", base)]
    out += [("w_syn", f"w_syn_{v:g}", change(w_syn_mv=v)) for v in w_syn_values(spec, auto_w_syn)]
    out += [("nt", f"nt_{k}", change(sign_policy=SAMPLED, sign_seed=spec.seed + k)) for k in range(r.nt_samples if probabilities else 0)]
    return out + [("min_weight", f"min_weight_{v}", change(min_weight=v)) for v in r.min_weights if v != spec.min_weight]


def run_robust_screen(spec: ExperimentSpec, neurons: DataFrame, edges: DataFrame, out_dir: str, *, replicate: tuple[DataFrame, DataFrame, DataFrame] | None = None, auto_w_syn: Sequence[float] | None = None) -> dict[str, DataFrame]:
    """Run the sweep for the reference and every variant, each in a folder that is skipped when it is done, and score the
    hits of the primary readout.

    ``replicate`` is another dataset as (neurons, edges, matches of types); hits that have a match there are
    silenced in it. Tables: effects, hits, controls, selection_stability, null."""
    spark, r, effects, chosen = neurons.sparkSession, spec.robustness, None, None
    for axis, name, variant in plan_variants(spec, auto_w_syn=auto_w_syn, probabilities=has_nt_probabilities(neurons)):
        folder = f"{out_dir.rstrip('/')}/{name}"
        if not is_done(spark, folder, variant):
            _clear(spark, folder)
            run_sweep(variant, neurons, edges, folder, extra=r.extra_candidates, n_off_route=r.negative_controls if axis == "reference" else 0)
        rows = spark.read.parquet(f"{folder}/sweep.parquet").where(F.col("readout") == r.primary_readout)
        rows = rows.select(F.lit(axis).alias("axis"), F.lit(name).alias("variant"), F.col("variant").alias("candidate"), "role", "stimulated_rate_hz", "difference", "ci_low", "ci_high", "q_value")
        picked = rows.where("role = 'candidate'").groupBy("axis", "variant").agg(F.collect_set("candidate").alias("picked"))
        effects, chosen = (rows, picked) if effects is None else (effects.unionByName(rows), chosen.unionByName(picked))
    effects = path_ops.settle(effects)
    reference = chosen.where("axis = 'reference'").select(F.col("picked").alias("ref"))
    stability = chosen.where("axis <> 'reference'").join(F.broadcast(reference)).select("variant", "axis", stats.jaccard(F.col("picked"), F.col("ref")).alias("jaccard"))
    asked = effects.where("axis = 'reference'").select("candidate", "role", "difference", "ci_low", "ci_high", "stimulated_rate_hz")
    null_p, sets = null_effects(spec, neurons, edges, asked) if r.null_sets else (None, None)
    same = replicate_outcomes(spec, asked.where("role = 'candidate'"), replicate) if replicate else None
    hits = stats.robust_hits(effects, alpha=spec.report.alpha, null_p=null_p, replicate=same)
    controls = asked.where("role <> 'candidate'").withColumn("source", F.when(F.col("role") == "off_route", "auto").otherwise("extra"))
    controls = controls.join(null_p.select("candidate", "null_p"), "candidate", "left") if null_p is not None else controls.withColumn("null_p", F.lit(None).cast("double"))
    controls = controls.select("candidate", "source", "stimulated_rate_hz", "difference", "ci_low", "ci_high", "null_p", (F.col("stimulated_rate_hz") > 0).alias("informative"))
    found = {"effects": effects.drop("stimulated_rate_hz"), "hits": hits, "controls": controls, "selection_stability": stability}
    return found | ({"null": sets} if sets is not None else {})


def _clear(spark: SparkSession, folder: str) -> None:
    """Remove what an unfinished run left in its own folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def null_effects(spec: ExperimentSpec, neurons: DataFrame, edges: DataFrame, effects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidate, null_p, degenerate) and the null sets' effects (super_class, bin, set, null_difference): random groups
    of the candidate's super class and size bin are silenced, from the active neurons or all."""
    c, s, r = prepare(dataclasses.replace(spec, robustness=None, controls=NO_CONTROLS), neurons, edges), spec, spec.robustness
    label = c.neurons.select("neuron_id", F.col(s.sweep.group_by).cast("string").alias("label"))
    groups = label.join(effects.select(F.col("candidate").alias("label")), "label", "left_semi")
    keys = path_ops.settle(stats.null_keys(c.neurons, groups.select("label", "neuron_id")))
    excluded = groups.select("neuron_id").unionByName(c.graph.spark.createDataFrame([(int(i),) for i in {*c.rates, *c.readouts[r.primary_readout]}], "neuron_id long"))
    run = lambda conditions: simulate(c.graph, conditions, n_trials=s.trials, n_steps=s.n_steps, params=c.params)
    stimulated = path_ops.settle(run([Condition("stimulated", c.rates, seed=s.seed)]))
    pool = stimulated.select("neuron_id").distinct() if r.null_pool == "active" else None
    sets = stats.draw_null_sets(c.neurons, keys, excluded, n_sets=r.null_sets, seed=s.seed + 3000, pool=pool).groupBy("super_class", "bin", "set").agg(F.sort_array(F.collect_list("neuron_id")).alias("ids")).collect()
    counts = stimulated
    if sets:
        counts = counts.unionByName(run([Condition(f"{x['super_class']}|{x['bin']}|{x['set']}", c.rates, tuple(x["ids"]), seed=s.seed) for x in sets]))
    hz = group_rates(counts, c.members.where(F.col("label") == r.primary_readout), n_trials=s.trials, seconds=c.seconds).groupBy("condition").agg(F.avg("hz").alias("hz"))
    ref = hz.where("condition = 'stimulated'").agg(F.coalesce(F.max("hz"), F.lit(0.0)).alias("ref"))
    part = F.split("condition", r"\|")
    nulls = path_ops.settle(hz.where("condition <> 'stimulated'").join(F.broadcast(ref)).select(part[0].alias("super_class"), part[1].cast("long").alias("bin"), part[2].cast("int").alias("set"), (F.col("hz") - F.col("ref")).alias("null_difference")))
    zero = nulls.groupBy("super_class", "bin").agg((F.count_if(F.col("null_difference") == 0) >= 0.5 * F.count("*")).alias("degenerate"))
    mine = effects.select("candidate", "difference").join(keys.withColumnRenamed("label", "candidate"), "candidate").select("candidate", "difference", "super_class", "bin")
    p = stats.null_p_values(mine, nulls, ["super_class", "bin"]).join(nulls.select("super_class", "bin").distinct(), ["super_class", "bin"], "left_semi")
    return p.join(zero, ["super_class", "bin"]).select("candidate", "null_p", "degenerate"), nulls


def replicate_outcomes(spec: ExperimentSpec, effects: DataFrame, other: tuple[DataFrame, DataFrame, DataFrame]) -> DataFrame:
    """(candidate, replicate) by silencing each candidate's match in another dataset: agrees, disagrees, no effect,
    or unmatched."""
    neurons, edges, matches = other
    names = [x["candidate"] for x in effects.select("candidate").distinct().orderBy("candidate").collect()]
    found, missing = map_candidates(names, matches)
    sweep = dataclasses.replace(spec.sweep, rank_by="activity", pathway=None, select=Selection(), max_items=1)
    same = dataclasses.replace(spec, dataset=spec.robustness.replicate or spec.dataset, robustness=None, controls=NO_CONTROLS, sweep=sweep)
    extra = [Selection(cell_type=t) for t in dict.fromkeys(found.values())]
    table = run_sweep(same, neurons, edges, extra=extra)["sweep"].where((F.col("readout") == spec.robustness.primary_readout) & (F.col("role") == "extra"))
    spark = neurons.sparkSession
    mapped = spark.createDataFrame([(k, Selection(cell_type=v).describe()) for k, v in found.items()], "candidate string, variant string")
    got = mapped.join(table.select("variant", F.col("difference").alias("theirs"), F.col("ci_low").alias("lo"), F.col("ci_high").alias("hi")), "variant").join(effects.select("candidate", "difference"), "candidate")
    clear = (F.col("lo") > 0) | (F.col("hi") < 0)
    verdict = F.when(~clear, "no effect").when(F.signum("theirs") == F.signum("difference"), "agrees").otherwise("disagrees")
    return got.select("candidate", verdict.alias("replicate")).unionByName(spark.createDataFrame([(x, "unmatched") for x in missing], "candidate string, replicate string"))


def degenerate_null_note(nulls: Sequence[float]) -> str | None:
    """A note if half or more of the null effects are exactly 0."""
    x = [v for v in nulls if not math.isnan(v)]
    zero = sum(v == 0 for v in x)
    return f"{zero} of {len(x)} null effects are 0" if x and zero / len(x) >= 0.5 else None


def map_candidates(candidates: Sequence[str], matches: DataFrame) -> tuple[dict[str, str], list[str]]:
    """Candidates mapped to a replicate dataset through matched types, and those without a match."""
    found: dict[str, str] = {}
    for r in matches.orderBy("type_a", F.desc("n_b"), "type_b").collect():
        found.setdefault(r["type_a"], r["type_b"])
    return {c: found[c] for c in candidates if c in found}, [c for c in candidates if c not in found]


def overlap(a: Sequence[str], b: Sequence[str]) -> float:
    """Shared over all members of two hit lists; 1 if both are empty."""
    return len({*a} & {*b}) / len({*a} | {*b}) if {*a} | {*b} else 1.0


def q_floor(n_variants: int, n_trials: int) -> float:
    """The least q-value that the rank test can give for so many trials and variants."""
    return float(min(1.0, n_variants * 2 / math.comb(2 * n_trials, n_trials)))



__all__ = ["Controls", "ExperimentSpec", "Report", "Robustness", "Selection", "Stimulus", "Sweep", "load_spec", "run_experiment", "run_robust_screen", "run_sweep", "spec_from_dict"]
