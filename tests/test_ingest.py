"""Totals of streamed edges: exactly once over failures, versions, and reads that don't grow with batches."""

import random

import pytest

from axonframe.streaming import ingest

COLS = "dataset string, version string, pre long, post long, weight int, roi string"


def _totals(spark, sink):
    rows = ingest.merged_edges(spark, sink).collect()
    assert len({(r["pre"], r["post"]) for r in rows}) == len(rows)
    return {(r["pre"], r["post"]): r["weight"] for r in rows}


@pytest.fixture
def few_buckets(monkeypatch):
    monkeypatch.setattr(ingest, "BUCKETS", 4)


def test_failures_between_any_two_steps(spark, tmp_path, monkeypatch, few_buckets):
    source, sink, check = (str(tmp_path / x) for x in ("in", "out", "chk"))
    rng, want = random.Random(1), {}
    real_publish, real_merge = ingest._publish, ingest.merge_batch

    def fail(*_):
        raise RuntimeError("lost")

    def published_then_lost(*args):
        real_publish(*args)
        raise RuntimeError("lost")

    for step in range(4):
        rows = [("d", "1", rng.randrange(6), rng.randrange(6), rng.randint(1, 9), None) for _ in range(40)]
        spark.createDataFrame(rows, COLS).coalesce(1).write.mode("append").parquet(source)
        before = _totals(spark, sink)
        assert before == want
        for _, _, a, b, w, _ in rows:
            want[a, b] = want.get((a, b), 0) + w
        # The batch is lost before its merge, before its manifest, or right after it.
        if step:
            name, broken = [("merge_batch", fail), ("_publish", fail), ("_publish", published_then_lost)][step - 1]
            monkeypatch.setattr(ingest, name, broken)
            with pytest.raises(Exception, match="lost"):
                ingest.stream_edges(spark, source, sink, check)
            monkeypatch.setattr(ingest, "merge_batch", real_merge)
            monkeypatch.setattr(ingest, "_publish", real_publish)
            assert _totals(spark, sink) == (want if step == 3 else before)
        ingest.stream_edges(spark, source, sink, check)
        assert _totals(spark, sink) == want
    ingest.merge_batch(spark, sink, 0)  # an old batch run again
    assert _totals(spark, sink) == want and ingest.manifest(spark, sink)["batch"] == 3
    files = len(ingest.merged_edges(spark, sink).inputFiles())
    assert files <= 4
    ingest.clear_versions(spark, sink)
    assert _totals(spark, sink) == want and len(ingest.merged_edges(spark, sink).inputFiles()) == files


def test_only_touched_buckets_are_rewritten(spark, tmp_path, few_buckets):
    source, sink, check = (str(tmp_path / x) for x in ("in", "out", "chk"))
    assert ingest.merged_edges(spark, sink).count() == 0
    spark.createDataFrame([("d", "1", i, i + 1, 1, None) for i in range(50)], COLS).write.mode("append").parquet(source)
    ingest.stream_edges(spark, source, sink, check)
    old = ingest.manifest(spark, sink)["folders"]
    assert set(old) == {"0", "1", "2", "3"}
    spark.createDataFrame([("d", "1", 3, 4, 2_000_000_000, None), ("d", "1", 3, 4, 2_000_000_000, "x")], COLS).coalesce(1).write.mode("append").parquet(source)
    ingest.stream_edges(spark, source, sink, check)
    new = ingest.manifest(spark, sink)["folders"]
    assert sum(old[k] != new[k] for k in old) == 1
    assert _totals(spark, sink)[3, 4] == 4_000_000_001
    ingest.clear_versions(spark, sink)
    assert len(_totals(spark, sink)) == 50
