"""Edges of the graph view are a plan that scales: dealt over tasks, and narrowed by ids where the tables are read."""

import contextlib
import io
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from axonframe.operators import benchmark, compare, graph as g, nulls, paths as p, sim, uncertainty
from axonframe.plans import graphview as view
from axonframe.plans.queries import ORACLE, QUERIES, TARGETS

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="test data are absent")


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_edges_of_customers_are_made_by_many_tasks(spark):
    rows = view.edges(spark, str(SF)).where(F.col("pre").between(view.CUSTOMER, view.PART - 1))
    assert rows.select(F.spark_partition_id()).distinct().count() > 1


def test_edges_are_not_summed_again(spark):
    """Two shuffles make the sums of line items and one deals customers; the graph adds none."""
    made, taken = plan(view.edges(spark, str(SF))), plan(view.graph(spark, str(SF)).edges)
    assert taken.count("Exchange hashpartitioning") == made.count("Exchange hashpartitioning")
    summed = g.build_graph(view.neurons(spark, str(SF)), view.edges(spark, str(SF))).edges
    assert sorted(summed.collect()) == sorted(view.graph(spark, str(SF)).edges.collect())


def test_ids_reach_the_tables(spark):
    text = plan(QUERIES["edges_semi_pre"](spark, str(SF)))
    assert "LeftSemi" not in text and text.count(f"IN ({','.join(map(str, TARGETS))})") >= 3


def test_powers_of_sources_read_only_what_they_meet(spark, monkeypatch):
    graph, sizes = view.graph(spark, str(SF)), []
    monkeypatch.setattr(p, "settle", lambda df: sizes.append(df) or df.persist())
    p.effective_connectivity(graph, 2, sources=TARGETS[:1])
    known = graph.edges.join(graph.nodes.where("sign <> 0").select(F.col("neuron_id").alias("pre")), "pre", "left_semi")
    assert max(df.count() for df in sizes if "_v" in df.columns or "value" in df.columns) < 0.8 * known.count()


def test_autapses_of_shared_ids_go_in_both(spark, tmp_path):
    """Supplier 1005 and part 5 are one body, so a line item of both is an autapse."""
    duckdb = pytest.importorskip("duckdb")
    con, rows = duckdb.connect(), {"supplier": "s_suppkey", "part": "p_partkey, p_brand", "lineitem": "l_suppkey, l_partkey, l_quantity"}
    con.execute("CREATE TABLE supplier AS SELECT unnest([5, 1005])::BIGINT AS s_suppkey")
    con.execute("CREATE TABLE part AS SELECT unnest([5, 6, 7])::BIGINT AS p_partkey, 'b' AS p_brand")
    con.execute("CREATE TABLE lineitem AS SELECT * FROM (VALUES (5::BIGINT, 5::BIGINT, 2.0::DOUBLE), (1005, 5, 3), (1005, 6, 4), (5, 7, 1)) t(l_suppkey, l_partkey, l_quantity)")
    for name, columns in rows.items():
        con.execute(f"COPY (SELECT {columns} FROM {name}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
    got = QUERIES["converted_hemibrain"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(ORACLE["converted_hemibrain"]).fetchall()) == [(5, 1005, 2), (1005, 1006, 4)]


def test_versions_are_compared_without_a_join(spark):
    old = spark.createDataFrame([(1, 2, 3), (1, 3, 4), (None, 2, 5)], "pre long, post long, weight int")
    new = spark.createDataFrame([(1, 2, 3), (1, 3, 5), (None, 2, 5), (4, 1, 1)], "pre long, post long, weight int")
    found = uncertainty.diff_edges(old, new)
    assert "Join" not in plan(found)
    assert set(map(tuple, found.collect())) == {(1, 3, 4, 5, "changed"), (4, 1, None, 1, "added"), (None, 2, None, 5, "added"), (None, 2, 5, None, "removed")}


def test_a_network_does_not_pass_the_driver(spark, monkeypatch):
    """The stored network equals the one read by the driver, and a simulation does without the latter."""
    graph, params = view.graph(spark, str(SF)), sim.LIFParams()
    want, got = sim.network(graph, params), sim.load_network(sim.store_network(graph, params), params)
    for name in ("ids", "indptr", "targets", "weights"):
        assert (getattr(want, name) == getattr(got, name)).all()
    monkeypatch.setattr(sim, "network", lambda *a: pytest.fail("read by the driver"))
    sim.simulate(graph, [sim.Condition("a", {TARGETS[0]: 150.0})], n_steps=50).collect()


def _unfactored(graph):
    return g.Graph(graph.nodes, graph.edges, graph.provenance)


def test_blocks_are_the_edges(spark):
    """Blocks hold the same edges as the plan, at any least weight and settled, and a graph with other edges has none."""
    for options in ({}, {"min_weight": 12}):
        graph = view.graph(spark, str(SF), **options)
        again = p.settled(graph)
        assert again.factored is not None and again.edges.count() == g.edge_count(graph) == g.edge_count(again)
        assert again.edges.exceptAll(graph.edges).isEmpty() and graph.edges.exceptAll(again.edges).isEmpty()
    assert g.Graph(graph.nodes, graph.edges.where("weight > 30"), blocks=graph.blocks).factored is None
    assert g.subset(graph, TARGETS).factored is None


def test_sums_over_blocks_do_not_make_their_edges(spark):
    """Counts, totals, label sums and products equal those over the edges, and their plans have no join of customers and suppliers
    by nation alone."""
    graph = view.graph(spark, str(SF), min_weight=3)
    names = graph.nodes.where("neuron_id % 7 <> 0").select("neuron_id", F.when(F.col("neuron_id") % 5 > 0, F.col("cell_type")).alias("label"))
    made = [lambda x: g.input_totals(x), lambda x: g.aggregate(x, "cell_type", signed=True), *(lambda x, o=o, h=h: g.label_sums(x, o, names, h) for o in ("pre", "post") for h in ("inner", "left"))]
    for f in made:
        got, want = f(graph), f(_unfactored(graph))
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.select(got.columns).collect()))
        assert [any("Join [c_nationkey" in line and "[s_nationkey" in line for line in plan(x).splitlines()) for x in (got, want)] == [False, True]
    source = graph.nodes.where(f"neuron_id >= {view.CUSTOMER} and neuron_id < {view.PART} and sign <> 0").first()["neuron_id"]
    for options in ({}, {"signed": False}, {"threshold": 1e-4}):
        value = lambda x: {(r["pre"], r["post"]): r["value"] for r in p.effective_connectivity(x, 3, sources=[source, TARGETS[1]], cumulative=True, **options).collect()}  # noqa: B023, E731
        got, want = value(graph), value(_unfactored(graph))
        assert got == pytest.approx(want, abs=1e-14)


def test_rewiring_counts_the_edges_of_blocks(spark):
    """A rewiring takes the edges of blocks as numbers a node, and pairs are looked up in the blocks."""
    graph = view.graph(spark, str(SF))
    for got, want in zip(nulls._stubs(graph), nulls._stubs(_unfactored(graph)), strict=True):
        assert sorted(got.collect()) == sorted(want.collect())
        assert [any("Join [c_nationkey" in line and "[s_nationkey" in line for line in plan(x).splitlines()) for x in (got, want)] == [False, True]
    e = nulls.rewired(graph, 4).edges
    assert e.count() == graph.edges.count() and e.groupBy("pre", "post").count().where("count > 1 or pre = post").isEmpty()
    kept = g.with_edges(graph, e.select("pre", "post"))
    assert sorted(kept.collect()) == sorted(g.with_edges(_unfactored(graph), e.select("pre", "post")).collect()) and 0 < kept.count() < 0.5 * e.count()


def _crossed(df) -> bool:
    return any("Join [c_nationkey" in line and "[s_nationkey" in line for line in plan(df).splitlines())


def test_fractions_are_found_before_edges_of_blocks_are_made(spark):
    graph, cut = view.graph(spark, str(SF)), lambda x: F.round(x, 9)
    for f in (lambda x: g.input_normalized(x, value=cut), lambda x: g.interpreter_inputs(x, value=cut)[0]):
        got, want = f(graph), f(_unfactored(graph))
        assert sorted(got.collect()) == sorted(want.select(got.columns).collect())
        rounded = [line for line in plan(got).splitlines() if "round(" in line]
        assert not _crossed(got) and _crossed(want) and not any("pre#" in line for line in rounded if "pre_block" in line)


@pytest.mark.parametrize("options", [{"min_weight": 12}, {"min_weight": 3, "min_edge_fraction": 0.01}])
def test_paths_through_blocks(spark, options):
    """Searches meet blocks, not their edges, and find the same nodes and paths."""
    graph, ends = view.graph(spark, str(SF)), (TARGETS[1:3], TARGETS)
    plain = _unfactored(graph)
    found = p._reach(p._parts(graph, *options.values()), *ends, 3)
    assert not _crossed(found) and _crossed(p._reach(p._parts(plain, *options.values()), *ends, 3))
    assert sorted(found.collect()) == sorted(p._reach(p._parts(plain, *options.values()), *ends, 3).collect())
    for f in (lambda x: p.find_paths(x, *ends, **options), lambda x: p.strongest_paths(x, *ends, 20, **options)):
        rows = lambda x: {tuple(r["path"]): (r["strength"], r["min_weight"]) for r in f(x).collect()}  # noqa: B023, E731
        got = rows(graph)
        assert got and got == rows(plain)


def test_a_simulation_reads_blocks_and_pages(spark, monkeypatch):
    """Edges of blocks are neither stored nor held, plain ones only where neurons spike; spikes equal those of the whole network."""
    graph, params = view.graph(spark, str(SF)), sim.LIFParams()
    drive = {i: 150.0 for i in TARGETS}
    whole, run = sim.network(graph, params), lambda net: sim.run_trial(net, drive, n_steps=600, seed=0, trial=1)
    folder = sim.store_parts(graph, params)
    known = graph.factored.plain.join(graph.nodes.where("sign <> 0").select(F.col("neuron_id").alias("pre")), "pre", "left_semi")
    assert spark.read.parquet(f"{folder}/edges").count() == known.count() < len(whole.targets)
    want = run(whole)
    for most in (10**9, 1):
        monkeypatch.setattr(sim, "MAX_NETWORK_EDGES", most)
        net = sim.open_network(folder, params)
        got = run(net)
        assert len(got[1]) > 50 and all((a == b).all() for a, b in zip(got, want, strict=True))
        assert most > 1 or len(net.held) == 1


def test_ends_of_edges_do_not_make_edges_of_blocks(spark):
    graph = view.graph(spark, str(SF))
    for end, least in (("pre", 15), ("post", 15), ("post", 50)):
        got, want = (g.ends(x, end, least) for x in (graph, _unfactored(graph)))
        assert not _crossed(got) and _crossed(want) and sorted(got.collect()) == sorted(want.collect())
    assert not _crossed(QUERIES["ids_intersect"](spark, str(SF)))


def test_a_profile_of_a_type_does_not_make_edges_of_blocks(spark):
    graph = view.graph(spark, str(SF))
    for way in ("out", "in"):
        got, want = (compare.type_profile(x, "BUILDING", direction=way) for x in (graph, _unfactored(graph)))
        assert not _crossed(got) and _crossed(want)
        assert dict(map(tuple, got.collect())) == pytest.approx(dict(map(tuple, want.collect())))


def test_signs_are_looked_up_for_nodes_of_blocks(spark, monkeypatch):
    """Signs meet the nodes of pre_blocks before their edges are made, also where they are too many to broadcast."""
    graph, same = view.graph(spark, str(SF)), lambda x: sorted(x.collect())
    monkeypatch.setattr(g, "BROADCAST_NODES", 10)
    for f in (g.signed_weights, lambda x: g.interpreter_inputs(x)[0]):
        got, want = f(graph), f(_unfactored(graph))
        assert not _crossed(got) and _crossed(want) and same(got) == same(want.select(got.columns))


def test_a_benchmark_does_not_make_edges_of_blocks(spark, monkeypatch):
    asked, run = [], benchmark.run_benchmark
    monkeypatch.setattr(benchmark, "run_benchmark", lambda x, *a, **k: asked.append(x) or run(x, *a, **k))
    QUERIES["benchmark_records"](spark, str(SF))
    assert asked[0].factored is not None


def test_queries_are_scored_in_chunks(spark, monkeypatch):
    """Chunks and steps of any size give the same records."""
    rows = lambda: sorted(map(repr, QUERIES["benchmark_records"](spark, str(SF)).collect()))
    want = rows()
    monkeypatch.setattr(benchmark, "CHUNK", 7)
    monkeypatch.setattr(benchmark, "CELLS", 100)
    assert rows() == want
