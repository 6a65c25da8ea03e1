import dataclasses

import numpy as np
import pytest

from axonframe.operators import benchmark, compare, experiments as x, sim, stats
from axonframe.operators.graph import build_graph
from axonframe.operators.nulls import NullResult, degree_preserving_rewire, null_distribution


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(0)
    nodes = [("d", "1", i, "sensory" if i < 5 else "central", f"T{i // 5}", "left" if i % 2 else "right", "gaba" if i % 7 == 6 else "acetylcholine") for i in range(40)]
    edges = sorted({(int(a), int(b)) for a, b in zip(rng.integers(0, 40, 400), rng.integers(0, 40, 400), strict=True) if a != b})
    edges = [("d", "1", a, b, int(w)) for (a, b), w in zip(edges, rng.integers(5, 60, len(edges)), strict=True)]
    n = spark.createDataFrame(nodes, "dataset string, version string, neuron_id long, super_class string, cell_type string, side string, nt_pred string")
    return n, spark.createDataFrame(edges, "dataset string, version string, pre long, post long, weight int")


SPEC = {
    "name": "t",
    "dataset": "d@1",
    "stimulate": [{"select": {"cell_type": "T0"}, "rate_hz": 150}],
    "readouts": [{"name": "out", "select": {"cell_type": "T7"}}],
    "trials": 3,
    "duration_ms": 40,
    "controls": {"degree_preserving_rewire": 0, "sign_shuffle": 0},
}
SWEEP = {"silence_each": {"select": {}, "max_items": 2}}
EXAMPLE = """
name: looming
dataset: malecns@1.0
network:
  min_weight: 2
  sign_policy: argmax
stimulate:
  - select: {cell_type: "LPLC*"}
    rate_hz: 80
sweep:
  silence_each:
    rank_by: pathway
    pathway: {readout: escape, max_hops: 2, min_weight: 7, min_edge_fraction: 0.02}
    group_by: cell_type
    max_items: 6
readouts:
  - name: escape
    select: {cell_type: "DNp0*"}
  - name: legs
    select: {super_class: vnc_motor}
duration_ms: 450
trials: 12
controls: {degree_preserving_rewire: 2, sign_shuffle: 3, unstimulated_baseline: false}
robustness:
  primary_readout: escape
  w_syn: auto
  min_weights: [4, 8]
  random_null: {n_sets: 25}
  extra_candidates: [{cell_type: LC6}]
"""


def test_spec_defaults_and_yaml(tmp_path):
    s = x.spec_from_dict({k: v for k, v in SPEC.items() if k != "controls"})
    assert len(s.sha256) == 64 and s.n_steps == 400 and s.controls == x.Controls(5, 5, True) and s.report == x.Report(30, 0.05, "unpaired")
    path = tmp_path / "e.yaml"
    path.write_text(EXAMPLE)
    e = x.load_spec(str(path))
    r = e.robustness
    assert e.report.statistics == "paired" and e.sweep.pathway.min_edge_fraction == 0.02 and e.controls == x.Controls(2, 3, False) and r.extra_candidates[0].cell_type == "LC6"
    assert (r.w_syn, r.nt_samples, r.min_weights, r.replicate, r.null_sets, r.null_pool, r.negative_controls) == ("auto", 8, (4, 8), "flywire@783", 25, "active", 1)
    with pytest.raises(ValueError, match="calibration"):
        x.plan_variants(e)
    plan = x.plan_variants(e, auto_w_syn=[0.2, 0.3], probabilities=False)
    assert [(a, v.min_weight) for a, _, v in plan] == [("reference", 2), ("w_syn", 2), ("w_syn", 2), ("min_weight", 4), ("min_weight", 8)]
    assert plan[1][2].controls == x.NO_CONTROLS


@pytest.mark.parametrize(
    "change",
    [
        {"typo": 1},
        {"readouts": []},
        {"readouts": [{"name": "o", "select": {"colour": "red"}}]},
        {"sweep": {"kind": "other"}},
        {"sweep": {"silence_each": {"max_items": 2}}},
        {"sweep": {"silence_each": {"rank_by": "pathway", "pathway": {"readout": "else"}}}},
        {"sweep": {"silence_each": {"rank_by": "pathway", "pathway": {"readout": "out", "max_hops": 5}}}},
        {"sweep": {"rate_hz": [10, 10]}},
        {"sweep": SWEEP, "perturb": {"silence": [{"select": {"cell_type": "T1"}}]}},
        {"network": {"sign_policy": "sampled"}},
        {"network": {"sign_seed": 1}},
        {"trials": 0},
        {"params": {"w_syn_mv": -1}},
        {"report": {"statistics": "paired"}},
        {"report": {"colour": 1}},
        {"robustness": {"primary_readout": "out"}},
        {"sweep": SWEEP, "robustness": {"primary_readout": "else"}},
        {"sweep": SWEEP, "robustness": {"primary_readout": "out", "replicate": "d@1"}},
        {"sweep": SWEEP, "robustness": {"primary_readout": "out", "w_syn": "some"}},
        {"sweep": SWEEP, "robustness": {"primary_readout": "out", "negative_controls": True}},
    ],
)
def test_spec_refusals(change):
    with pytest.raises(ValueError):
        x.spec_from_dict(SPEC | change)


@pytest.mark.parametrize(("said", "sets"), [(None, 40), (True, 40), (False, 0), (0, 0), (7, 7), ({"n_sets": 3}, 3)])
def test_random_null(said, sets):
    block = {"primary_readout": "out"} | ({} if said is None else {"random_null": said})
    assert x.spec_from_dict(SPEC | {"sweep": SWEEP, "robustness": block}).robustness.null_sets == sets


def test_experiment(tables, tmp_path):
    spec = x.spec_from_dict(SPEC | {"perturb": {"silence": [{"select": {"cell_type": "T1"}}]}, "controls": {"degree_preserving_rewire": 1, "sign_shuffle": 1}, "report": {"top_neurons": 2}})
    found = x.run_experiment(spec, *tables, out_dir=f"file://{tmp_path}/run")
    rows = {r["comparison"]: r for r in found["readouts"].collect()}
    assert set(rows) == {"perturbed_vs_stimulated", "stimulated_vs_baseline", "stimulated_vs_degree_preserving_rewire", "stimulated_vs_sign_shuffle"}
    assert all(0 <= r["q_value"] <= 1 and r["n_neurons"] == 5 and r["n_test"] == 3 for r in rows.values())
    assert {(r["condition"], r["control"]) for r in found["conditions"].collect()} <= {("stimulated", "none"), ("perturbed", "none"), ("stimulated", "degree_preserving_rewire"), ("stimulated", "sign_shuffle")}
    assert all(r["rank"] <= 2 for r in found["top_neurons"].collect())
    with pytest.raises(FileExistsError):
        x.run_experiment(spec, *tables, out_dir=f"file://{tmp_path}/run")


def test_screen(tables, tmp_path):
    block = {"primary_readout": "out", "w_syn": [0.2], "nt_samples": 2, "min_weights": [3], "random_null": {"n_sets": 2, "pool": "all"}, "extra_candidates": [{"cell_type": "T3"}]}
    spec = x.spec_from_dict(SPEC | {"sweep": SWEEP, "robustness": block})
    matches = tables[0].sparkSession.createDataFrame([(f"T{i}", f"T{i}", 5, 5) for i in range(6)], "type_a string, type_b string, n_a long, n_b long")
    screen = x.run_robust_screen(spec, *tables, out_dir=f"file://{tmp_path}/screen", replicate=(*tables, matches))
    assert screen["effects"].where("axis = 'reference' and role = 'candidate'").count() == 2
    assert len(screen["hits"].columns) == 21 and screen["hits"].count() <= 2
    assert {r["variant"] for r in screen["selection_stability"].collect()} == {"w_syn_0.2", "min_weight_3"}
    assert {r["source"] for r in screen["controls"].collect()} <= {"auto", "extra"} and screen["controls"].where("source = 'extra'").count() == 1
    assert screen["null"].count() >= 2
    assert x.is_done(tables[0].sparkSession, f"file://{tmp_path}/screen/reference", dataclasses.replace(spec, robustness=None))


def test_rate_sweep(tables):
    found = x.run_sweep(x.spec_from_dict(SPEC | {"sweep": {"rate_hz": [50, 150, 300]}, "report": {"statistics": "paired"}}), *tables)
    assert {(r["variant"], r["reference"]) for r in found["sweep"].collect()} == {("150 Hz", "50 Hz"), ("300 Hz", "50 Hz")}


def test_robust_hits(spark):
    rows = [("reference", "r", c, "candidate", d, d - 1.0, d + 1.0, q) for c, d, q in (("a", 5.0, 0.01), ("b", -9.0, 0.01), ("c", 3.0, 0.5), ("d", 4.0, 0.02))]
    rows += [("w_syn", "w1", c, "candidate", d, d - 1.0, d + 1.0, 0.5) for c, d in (("a", 4.0), ("b", 8.0), ("d", 0.1))]
    rows += [("nt", f"n{k}", c, "candidate", d, d - 1.0, d + 1.0, 0.5) for k in range(4) for c, d in (("a", 4.0 if k else 0.0), ("b", -4.0), ("d", -3.0 if k else 3.0))]
    effects = spark.createDataFrame(rows, "axis string, variant string, candidate string, role string, difference double, ci_low double, ci_high double, q_value double")
    null_p = spark.createDataFrame([("a", 0.01, False), ("b", 0.5, True), ("d", 0.5, False)], "candidate string, null_p double, degenerate boolean")
    got = stats.robust_hits(effects, null_p=null_p).collect()
    assert [(r["candidate"], r["tier"], r["failed_axes"], r["uninformative_axes"]) for r in got] == [("a", "Strong", "", ""), ("b", "Conditional", "w_syn", "random_null"), ("d", "Fragile", "w_syn, nt, random_null", "")]
    assert (got[0]["nt_holds"], got[2]["nt_flips"], got[1]["w_syn_detail"], got[0]["untested_axes"]) == ("3/4", "n1, n2, n3", "w1: flips", "min_weight")


def test_kernel_delay_and_silencing(spark):
    n = spark.createDataFrame([(1, "acetylcholine"), (2, "acetylcholine")], "neuron_id long, nt_pred string")
    e = spark.createDataFrame([(1, 2, 399)], "pre long, post long, weight int")
    net = sim.network(build_graph(n, e), sim.LIFParams())
    assert net.params.delay_steps == 18 and net.params.refractory_steps == 22 and net.params.kick == pytest.approx(68.75)
    steps, cells = sim.run_trial(net, {}, n_steps=200, seed=0, trial=0, events=[(0, 1)])
    assert steps[cells == 0].tolist() == [1]
    assert steps[cells == 1].min() > 19
    steps, cells = sim.run_trial(net, {}, n_steps=200, seed=0, trial=0, events=[(0, 1)], silenced=(1,))
    assert (cells == 0).all()
    a, b = (sim.run_trial(net, {1: 200.0}, n_steps=300, seed=5, trial=2) for _ in range(2))
    assert (a[0] == b[0]).all() and len(a[0])


def test_w_syn_selection(spark):
    rows = [(w, r, 100.0 * min(1.0, w * r / 100) + t) for w in (0.5, 0.7, 0.9, 1.1) for r in (100.0, 200.0) for t in (0.0, 0.1, 0.2)]
    got = sim.select_w_syn(spark.createDataFrame(rows, "w_syn_mv double, rate_hz double, readout_rate_hz double"), n_boot=50)
    assert got["status"] == "calibrated" and got["w_syn_mv"] == pytest.approx(0.8, abs=0.02)


def test_nulls_keep_degrees(tables):
    g = build_graph(*tables)
    r = degree_preserving_rewire(g, 1)
    for c in ("pre", "post"):
        deg = lambda e: sorted((x[c], x["count"]) for x in e.groupBy(c).count().collect())  # noqa: B023, E731
        assert deg(g.edges) == deg(r.edges)
    assert r.edges.where("pre = post").count() == 0 and r.edges.select("pre", "post").distinct().count() == r.edges.count()
    res = null_distribution(lambda h: h.edges.where("weight > 30 and pre < 5").count(), g, n_nulls=2)
    assert res.observed == res.nulls[0] and 0 < res.p_two_sided <= 1
    assert NullResult(3.0, (1.0, 1.0)).z == float("inf")


def test_atlas_scores_and_benchmark(spark, tables):
    g = build_graph(*tables)
    atlas = compare.build_atlas(g)
    wide = compare.wide_scores(compare.score(atlas, atlas.profiles, top_k=3)).collect()
    assert len(wide) == 40 and all(len(r["labels"]) == 3 and r["s1"] >= r["scores"][1] for r in wide)
    called = compare.classify(g, atlas, cell_type="T3")
    assert called.count() == 5 and {r["call"] for r in called.collect()} <= {"type", "ambiguous", "unknown"}
    with pytest.raises(ValueError):
        compare.classify(g, atlas)
    q = build_graph(tables[0].selectExpr("*", "cell_type as fafb_783_cell_type"), tables[1])
    rec = benchmark.run_benchmark(q, atlas, query_ref="q", max_types=6)
    assert rec.where("protocol = 'open' and correct").count() == 0
    assert {r["type"] for r in rec.collect()} <= {f"T{i}" for i in range(8)}
    data = rec.toPandas()
    if 0 < data[data.protocol == "closed"].correct.mean() < 1:
        cal = benchmark.fit_calibration(rec, atlas, reference="r", n_folds=3)
        again = benchmark.Calibration.from_json(cal.to_json())
        assert again.id == cal.id and cal.incompatible_with(atlas) is None


def test_compare_type(tables):
    g = build_graph(*tables)
    c = compare.compare_type(g, g, "T2", n_permutations=50)
    assert c.between == pytest.approx(0) and 0 < c.p <= 1 and c.differences


def test_logistic_and_ece(spark):
    rng = np.random.default_rng(1)
    x_ = rng.normal(size=(400, 2))
    y = (rng.random(400) < 1 / (1 + np.exp(-(2 * x_[:, 0] - 1)))).astype(float)
    m = compare.fit_logistic(x_, y, features=("a", "b"))
    z = x_ @ np.array(m.coef) + m.intercept
    grad = x_.T @ (1 / (1 + np.exp(-z)) - y) + 1e-4 * np.array(m.coef)
    assert np.abs(grad).max() < 1e-5
    df = spark.createDataFrame([(0.05, 0.0), (0.95, 1.0), (None, 1.0)], "p double, y double")
    assert compare.ece(df, "p", "y") == pytest.approx(0.05) and compare.brier(df.dropna(), "p", "y") == pytest.approx(0.0025)


def test_cli(capsys):
    from axonframe.cli import main

    assert main(["data", "list"]) == 0 and "malecns@1.0" in capsys.readouterr().out
