"""Every registered graph query against its SQL in DuckDB on the smallest test data."""

import math
from pathlib import Path

import pytest

from axonframe.plans.queries import ORACLE, QUERIES

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="test data are absent")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def _norm(v):
    if v is None or isinstance(v, (str, bool)):
        return str(v)
    v = float(v)
    return "nan" if math.isnan(v) else f"{v + 0.0:.6f}".replace("-0.000000", "0.000000")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, str(SF))
    columns = sorted(df.columns)
    rows = sorted(tuple(map(_norm, r)) for r in df.select(*columns).collect())
    if name not in ORACLE:
        assert rows
        return
    got = duck.execute(ORACLE[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == columns
    order = sorted(range(len(names)), key=lambda i: names[i])
    assert rows == sorted(tuple(_norm(r[i]) for i in order) for r in got.fetchall())


def test_simulation_has_all_neurons(spark):
    from axonframe.plans import graphview as view

    want = {r[0] for r in view.neurons(spark, str(SF)).select("neuron_id").collect()}
    got = QUERIES["lif_rates"](spark, str(SF)).select("condition", "neuron_id").collect()
    for name in ("stimulated", "silenced"):
        assert {r["neuron_id"] for r in got if r["condition"] == name} == want


def test_registered_path_stability_has_no_cap(spark, monkeypatch):
    from axonframe.operators import uncertainty

    asked, found = [], uncertainty.find_paths
    monkeypatch.setattr(uncertainty, "find_paths", lambda *a, **k: asked.append(k) or found(*a, **k))
    QUERIES["path_stability"](spark, str(SF))
    assert [k["max_paths"] for k in asked] == [None]


def test_entry_imports():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
