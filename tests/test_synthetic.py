import pytest

from axonframe.operators import paths, sim
from axonframe.operators.compare import vocab_partner_names
from axonframe.operators.graph import aggregate, build_graph, label_weight
from axonframe.sources.synthetic import synthetic_connectome


def test_synthetic_connectome(spark):
    n, e = (x.collect() for x in synthetic_connectome(spark, 40, 700, seed=3))
    assert len({r["neuron_id"] for r in n}) == 40 and all(abs(sum(r[c] for c in n[0].__fields__ if c.startswith("nt_p_")) - 1) < 1e-9 for r in n)
    assert all(r["nt_conf"] == max(r[c] for c in n[0].__fields__ if c.startswith("nt_p_")) for r in n)
    assert len({(r["pre"], r["post"]) for r in e}) == 700 and all(r["pre"] != r["post"] and r["weight"] >= 1 for r in e)
    assert {r["pre"] for r in e} | {r["post"] for r in e} <= {r["neuron_id"] for r in n}
    with pytest.raises(ValueError):
        synthetic_connectome(spark, 3, 7)


def test_paths_equal_plain_self_joins(spark):
    g = build_graph(*synthetic_connectome(spark, 30, 150, seed=1))
    s, t = [10_001, 10_002], [10_010, 10_011, 10_001]
    want = sorted(r["path"] for r in paths.all_paths(g, s, t, max_hops=3).collect())
    got = paths.find_paths(g, s, t, max_hops=3).collect()
    assert sorted(r["path"] for r in got) == want and want and not any(r["truncated"] for r in got)
    assert all(r["truncated"] for r in paths.find_paths(g, s, t, max_hops=3, max_paths=1).collect())


def test_label_weight_and_names(spark):
    g = build_graph(*synthetic_connectome(spark, 30, 200, seed=2))
    table = aggregate(g, "super_class").cache()
    row = table.first()
    assert label_weight(table, row["pre_label"], row["post_label"]) == row["weight"]
    with pytest.raises(KeyError):
        label_weight(table, row["pre_label"], "nowhere")
    nodes = spark.createDataFrame([(1, "A", "B"), (2, "X", "B"), (3, None, "Y"), (4, "A", None)], "neuron_id long, fafb_783_cell_type string, manc_121_cell_type string")
    known = spark.createDataFrame([("A",), ("B",)], "label string")
    assert {r["neuron_id"]: r["label"] for r in vocab_partner_names(nodes, known).collect()} == {1: "A", 2: "B", 3: None, 4: "A"}


def test_event_cap(spark):
    events = spark.createDataFrame([("c", 0, s, n) for s in range(5) for n in range(3)], "condition string, trial int, step long, neuron_id long")
    got = sim.cap_events(events, 4).collect()
    assert [(r["step"], r["neuron_id"]) for r in got] == [(0, 0), (0, 1), (0, 2), (1, 0)] and all(r["truncated"] for r in got)
    assert not any(r["truncated"] for r in sim.cap_events(events, 15).collect())
