from pyspark.sql import functions as F

from axonframe.operators import paths as p
from tests.test_graph import build


def star(spark, n):
    """A hub between n neurons before and n behind it, and a chain beside it."""
    hub, chain = 10_000, [20_000, 20_001, 20_002, 20_003]
    ids = [*range(n), hub, *range(1000, 1000 + n), *chain]
    edges = [(i, hub, 1 + i % 7) for i in range(n)] + [(hub, 1000 + i, 1 + i % 5) for i in range(n)] + [(a, b, 3) for a, b in zip(chain, chain[1:], strict=False)]
    total = {i: sum(w for _, b, w in edges if b == i) for i in ids}
    return build(spark, [(i, "T", "gaba" if i % 3 == 0 else "acetylcholine", total[i] or 1) for i in ids], edges)


def test_cells_of_a_hub_are_even(spark):
    left = spark.range(400).select(F.when(F.col("id") < 390, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("x"))
    right = spark.range(600).select(F.when(F.col("id") < 300, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("y"))
    rows = right.groupBy("k").agg(F.count("*").alias("_m"))
    assert [(r["k"], r["_a"], r["_b"]) for r in p.heavy_keys(left, rows, "k", 2000).collect()] == [(7, 8, 8)]
    want = sorted(map(tuple, left.join(right, "k").select("k", "x", "y").collect()))
    for cell_rows in (2000, 50, 10**9):
        assert sorted(map(tuple, p.grid_join(left, right, "k", cell_rows=cell_rows).select("k", "x", "y").collect())) == want
    cut = p.grid_join(left, right, "k", cell_rows=2000).where("k = 7")
    sizes = sorted(r["count"] for r in cut.groupBy(F.pmod(F.xxhash64("k", "x"), F.lit(8)), F.pmod(F.xxhash64("k", "y"), F.lit(8))).count().collect())
    assert len(sizes) == 64 and sizes[-1] <= 3 * sizes[32]


def test_parts_follow_the_smaller_side(spark):
    left = spark.createDataFrame([(1, 0)], "k long, x long")
    rows = spark.createDataFrame([(1, 1000)], "k long, _m long")
    assert [(r["_a"], r["_b"]) for r in p.heavy_keys(left, rows, "k", 100).collect()] == [(1, 10)]


def test_powers_and_paths_through_a_hub(spark, monkeypatch):
    t = star(spark, 60)
    got = []
    for cell_rows, ids in ((10**9, 10**6), (100, 1)):
        monkeypatch.setattr(p, "CELL_ROWS", cell_rows)
        power = {(r["pre"], r["post"]): round(r["value"], 12) for r in p.effective_connectivity(t, 2).collect()}
        monkeypatch.setattr(p, "BROADCAST_IDS", ids)
        found = sorted(tuple(r["path"]) for r in p.find_paths(t, [0, 1, 2, 20_000], [1000, 1001, 20_003], max_hops=5).collect())
        monkeypatch.undo()
        got.append((power, found))
    assert got[0] == got[1]
    assert len(got[0][0]) == 60 * 60 + 2 and len(got[0][1]) == 7


def test_empty_powers_end_the_products(spark):
    t = star(spark, 5)
    assert [r["value"] for r in p.effective_by_hops(t, [20_000], [20_001], max_hops=6, signed=False).orderBy("hops").collect()] == [1.0, 0, 0, 0, 0, 0]
    assert p.effective_connectivity(t, 6).count() == 0
    assert p.find_paths(t, [20_002], [20_003], max_hops=9).count() == 1
