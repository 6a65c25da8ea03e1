import json

import pytest

from axonframe.operators import access as a
from axonframe.sources.registry import Dataset, DataFile, Registry, pull


@pytest.fixture
def lines(spark):
    return spark.createDataFrame([("L1", 2.0, ["LB1a"], [1]), ("L2", 1.0, ["LB1a", "LB2"], [1, 2]), ("L3", None, ["LB1ab"], [])], "line string, quality double, cell_types array<string>, em_body_ids array<long>")


def test_lines(spark, lines):
    assert [r["line"] for r in a.lines_for_type(lines, "LB1*").collect()] == ["L2", "L1", "L3"]
    assert [r["line"] for r in a.lines_for_type(lines, "LB1a", min_quality=1).collect()] == ["L2"]
    assert a.types_for_line(lines, "L2") == ["LB1a", "LB2"] and a.lines_for_body(lines, 2).count() == 1
    with pytest.raises(KeyError):
        a.types_for_line(lines, "nope")
    hits = spark.createDataFrame([("LB1a",), ("LB1ab",), ("LB", ), ("X",)], "label string")
    got = {r["label"]: (r["lines"], r["line_match"]) for r in a.attach_lines(hits, lines).collect()}
    assert got["LB1a"] == (["L2", "L1"], "exact") and got["LB1ab"] == (["L3"], "exact") and got["LB"][1] == "glob" and got["X"] == (None, "none")


def test_matches(spark):
    rows = [(("a:b:N1", "lib"), 0.5, 10, False), (("a:b:N1", "lib"), 0.9, 5, True), (("other", None), 0.1, 1, False)]
    df = spark.createDataFrame(rows, "image struct<publishedName: string, libraryName: string>, normalizedScore double, matchingPixels int, mirrored boolean")
    got = a.best_matches(df, direction="lm_to_em").collect()
    assert [(r["body"], r["score"], r["pixels"], r["n_matches"], r["mirrored"]) for r in got] == [("N1", 0.9, 10, 2, True), ("other", 0.1, 1, 1, False)]


def test_selection(spark):
    n = spark.createDataFrame([(3, "LB1a", "left"), (1, "LB1b", "right"), (2, None, "left")], "neuron_id long, cell_type string, side string")
    assert a.resolve_selection(n, globs={"cell_type": "LB1[ab]"}) == [1, 3]
    assert a.resolve_selection(n, globs={"cell_type": "*", "side": "left"}) == [3]
    assert a.resolve_selection(n) == [1, 2, 3] and a.resolve_selection(n, ids=[3, 1, 3]) == [1, 3]
    with pytest.raises(KeyError):
        a.resolve_selection(n, ids=[9])
    with pytest.raises(ValueError):
        a.resolve_selection(n, globs={"cell_type": "zzz"})


def test_pull_and_cache(tmp_path):
    (tmp_path / "src.csv").write_text("a\n1\n")
    url, calls = (tmp_path / "src.csv").as_uri(), []
    d = Dataset("d", "1", (DataFile("a.csv", url, "neurons"), DataFile("b.csv", url, "weights", "weights", bytes=4)))
    convert = lambda ds, raw, store, files: calls.append([f.name for f in files]) or {"n": len(files)}
    for level in ("meta", "meta", "weights", "meta"):
        pull(d, str(tmp_path / "cache"), convert, level=level)
    assert calls == [["a.csv"], ["a.csv", "b.csv"]]
    bad = Dataset("e", "1", (DataFile("a.csv", url, "neurons", sha256="0" * 64),))
    with pytest.raises(ValueError):
        pull(bad, str(tmp_path / "cache"), convert)
    r = Registry()
    r.add({"name": "d", "version": 1, "files": [{"name": "a", "url": url, "role": "x"}]})
    assert r.list() == ["d@1"] and r.get("d@1").by_role("x").name == "a"
    with pytest.raises(KeyError):
        r.get("z@1")
    seen = []
    fetch = lambda: seen.append(1) or {"results": [{"image": {"publishedName": "n"}}]}
    for _ in range(2):
        assert a.cached_json(str(tmp_path / "c" / "i.json"), fetch)["results"]
    assert len(seen) == 1 and a.off_target_count(str(tmp_path / "c"), ["i"]) == 1 and a.off_target_count(str(tmp_path / "c"), ["i", "j"]) is None
    assert json.loads((tmp_path / "c" / "i.json").read_text())
