import pytest
from pyspark.sql import functions as F

from axonframe.functions import scalars
from axonframe.schema import conform_edges, conform_neurons
from axonframe.sources import convert, store
from axonframe.streaming.ingest import merged_edges, stream_edges


def test_store_round_trip(spark, tmp_path):
    n = conform_neurons(spark.createDataFrame([("d", "1", 2, "B"), ("d", "1", 1, None)], "dataset string, version string, neuron_id long, cell_type string"))
    e = conform_edges(spark.createDataFrame([("d", "1", 1, 2, 5), ("d", "1", 2, 1, 1)], "dataset string, version string, pre long, post long, weight int"))
    root = f"file://{tmp_path}/d/1"
    store.write_store(n, e, root, {"dataset": "d", "citations": ["someone"]})
    s = store.Store.open(spark, "d@1", f"file://{tmp_path}")
    assert s.provenance["counts"] == {"neurons": 2, "edges": 2}
    assert [r["neuron_id"] for r in s.neurons().collect()] == [1, 2]
    assert s.neurons(["neuron_id"], "cell_type is not null").collect()[0][0] == 2
    assert [(r["pre"], r["post"]) for r in s.edges(min_weight=2).collect()] == [(1, 2)]
    assert s.edges(post=[1]).count() == 1
    assert s.query("select sum(weight) as w from {edges} where pre = ?", [1]).first()["w"] == 5
    assert s.citation_text() == "someone" and len(s.fingerprint) == 64
    with pytest.raises(KeyError):
        s.neurons(["nope"])
    with pytest.raises(FileNotFoundError):
        store.Store(spark, str(tmp_path / "missing"))
    with pytest.raises(ValueError):
        conform_edges(n)


def _feather(path, table, rows):
    import pyarrow.ipc as ipc

    with ipc.new_file(str(path), table.schema) as w:
        for b in table.to_batches(max_chunksize=rows):
            w.write_batch(b)
    return str(path)


def test_feather_by_batches(spark, tmp_path):
    import pyarrow as pa

    n = 100
    t = pa.table({"body": pa.array([None, *range(1, n)], pa.int64()), "type": pa.array(["a", None] * (n // 2)).dictionary_encode(), "long": pa.array(["x"] * n, pa.large_string())})
    path = _feather(tmp_path / "t.feather", t, 3)
    df = store.read_feather(spark, path)
    assert df.rdd.getNumPartitions() == 5  # 34 batches, 8 a task
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(zip(*t.to_pydict().values(), strict=True), key=repr)
    two = store.read_feather(spark, f"file://{path}", ["type", "body"])
    assert two.columns == ["type", "body"] and two.agg(F.sum("body"), F.count_if(F.col("type") == "a")).first()[:] == (n * (n - 1) // 2, n // 2)
    assert store.read_feather(spark, _feather(tmp_path / "e.feather", t.slice(0, 0), 3)).count() == 0
    with pytest.raises(Exception, match="unknown columns"):
        store.read_feather(spark, path, ["nope"]).collect()


def _tar(path, members, mode="w:gz"):
    import io
    import tarfile

    with tarfile.open(path, mode) as tar:
        for name, text in members.items():
            info = tarfile.TarInfo(name)
            info.size = len(text.encode())
            tar.addfile(info, io.BytesIO(text.encode()))
    return str(path)


def test_members_of_archives(spark, tmp_path):
    big = 720575940600000001
    rows = [(big + i, None if i % 5 == 0 else i, f'a "{i}", b\nnext' if i % 7 == 0 else "é") for i in range(3000)]
    body = "id,w,note\n" + "".join(f'{i},{"" if w is None else w},"{note.replace(chr(34), chr(34) * 2)}"\n' for i, w, note in rows)
    members = {"deep/first.csv": "x\n1\n", "deep/x.csv": body, "x.csv": "id,w\n0,0\n", "header.csv": "id,w\n", "empty.csv": ""}
    for mode, name in (("w:gz", "x.tar.gz"), ("w", "x.tar")):
        path = _tar(tmp_path / name, members, mode)
        got = store.read_tar_member(spark, path, "x.csv", "note string, id long, w int")
        assert sorted((r["id"], r["w"], r["note"]) for r in got.collect()) == rows
        assert store.read_tar_member(spark, path, "x.csv", "id long").agg(F.max("id")).first()[0] == big + 2999
        text = store.read_tar_member(spark, f"file://{path}", "first.csv")
        assert text.schema.simpleString() == "struct<x:string>" and text.first()["x"] == "1"
        assert store.read_tar_member(spark, path, "header.csv").count() == 0 and store.read_tar_member(spark, path, "empty.csv").count() == 0
        with pytest.raises(Exception, match="no y.csv"):
            store.read_tar_member(spark, path, "y.csv", "id long").collect()
        with pytest.raises(Exception, match="int64"):
            store.read_tar_member(spark, path, "x.csv", "note long").collect()


def test_pull_of_an_archive(spark, tmp_path):
    """A release whose neurons and edges are members of one archive, read as text and cast by the converter."""
    from axonframe.sources.registry import Registry, pull, read_raw, store_converter
    from axonframe.sources.store import Store

    a, b = 720575940600000001, 720575940600000003
    path = _tar(tmp_path / "export.tar.gz", {"v/neurons.csv": f"bodyId,type,instance\n{a},T1,T1_L\n{b},,\n", "v/total.csv": f"bodyId_pre,bodyId_post,weight\n{a},{b},12\n{b},{b},3\n{a},5,1\n"})
    members = {"neurons.csv": "traced", "total.csv": "connections"}
    registry = Registry()
    registry.add({"name": "hemibrain", "version": "1.2.1", "files": [{"name": "export.tar.gz", "url": f"file://{path}", "role": "archive", "members": members}]})
    registry.add({"name": "hemibrain", "version": "2", "files": [{"name": "export.tar.gz", "url": f"file://{path}", "role": "archive", "members": {"neurons.csv": "traced", "total.csv": "traced"}}]})
    cache = str(tmp_path / "cache")
    got = Store(spark, str(pull(registry.get("hemibrain@1.2.1"), cache, store_converter(spark))))
    assert [(r["pre"], r["post"], r["weight"]) for r in got.edges().collect()] == [(a, b, 12)]
    assert [(r["neuron_id"], r["cell_type"]) for r in got.neurons().collect()] == [(a, "T1"), (b, None)]
    with pytest.raises(ValueError, match="two files"):
        pull(registry.get("hemibrain@2"), cache, store_converter(spark))
    with pytest.raises(ValueError, match="no reader"):
        read_raw(spark, "x.pickle")


def test_scalars(spark):
    df = spark.createDataFrame([("L", "LB1a, LB1d,", "a:b:c", " GABA "), (None, "", "x", None)], "s string, t string, n string, nt string")
    r = df.select(scalars.normalize_side(F.col("s")), scalars.tokens(F.col("t")), scalars.published_name(F.col("n"))["name"], scalars.normalize_nt(F.col("nt")), scalars.glob_match(F.col("t"), "LB[!2]*")).collect()
    assert r[0][:] == ("left", ["LB1a", "LB1d"], "c", "gaba", True)
    assert r[1][:] == (None, [], "x", None, False)
    with pytest.raises(Exception, match="unrecognised"):
        df.select(scalars.normalize_nt(F.lit("sugar"))).collect()
    with pytest.raises(KeyError):
        scalars.normalize_super_class("nowhere", F.lit("x"))
    with pytest.raises(ValueError):
        scalars.sign_table({"gaba": 2})
    assert df.limit(1).select(scalars.size_bin(F.lit(6.0)), scalars.jaccard(F.array(F.lit(1)), F.array(F.lit(1), F.lit(2)))).first()[:] == (8, 0.5)


def test_converters(spark):
    a = spark.createDataFrame([(1, "cb_intrinsic", "L", "T1"), (2, "vnc_motor", "R", ""), (3, None, None, "T1")], "bodyId long, superclass string, somaSide string, type string")
    for c in "status statusLabel class subclass instance somaNeuromere flywireType hemibrainType mancType itoleeHl trumanHl dimorphism vfbId".split():
        a = a.withColumn(c, F.lit(None).cast("string"))
    nt = spark.createDataFrame([(1, "gaba", "gaba", 0.9, "gaba", 0.7, None), (2, "glut", "ach", 0.8, "glutamate", 0.6, None)], "body long, consensus_nt string, predicted_nt string, predicted_nt_confidence double, celltype_predicted_nt string, celltype_predicted_nt_confidence double, ground_truth string")
    w = spark.createDataFrame([(1, 2, 5), (2, 1, 3), (1, 3, 7), (3, 2, 2)], "body_pre long, body_post long, weight int")
    n, e = convert.convert_malecns(a, nt, w)
    got = {r["neuron_id"]: r for r in n.collect()}
    assert set(got) == {1, 2} and got[1]["nt_conf"] == 0.9 and got[2]["nt_conf"] == 0.6 and got[2]["nt_pred"] == "glutamate" and got[2]["cell_type"] is None
    assert got[2]["input_synapses_total"] == 7 and got[2]["input_synapses_neurons"] == 5 and got[1]["output_synapses_total"] == 12
    assert {(r["pre"], r["post"]) for r in e.collect()} == {(1, 2), (2, 1)}
    c = spark.createDataFrame([(7, True), (8, True)], "id long, Completed boolean")
    x = spark.createDataFrame([(7, 8, 4, -1)], "Presynaptic_ID long, Postsynaptic_ID long, Connectivity int, Excitatory int")
    n, e = convert.convert_shiu(c, x)
    assert {r["neuron_id"]: r["nt_pred"] for r in n.collect()} == {7: "gaba", 8: None} and e.first()["sign"] == -1
    lines = convert.convert_lines(spark.createDataFrame([("L1", 2.0, "A; B,", "12, x, 3")], "line string, quality double, cell_types string, em_ids string")).first()
    assert lines["cell_types"] == ["A", "B"] and lines["em_body_ids"] == [12, 3]


def test_streamed_edges_count_once(spark, tmp_path):
    cols = "dataset string, version string, pre long, post long, weight int, roi string"
    write = lambda rows: spark.createDataFrame(rows, cols).write.mode("append").parquet(str(tmp_path / "in"))
    go = lambda: stream_edges(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "chk"), files_per_trigger=1)
    write([("d", "1", 1, 2, 3, "x"), ("d", "1", 1, 2, 4, "y")])
    go()
    write([("d", "1", 1, 2, 10, "z"), ("d", "1", 2, 1, 1, None)])
    go()
    go()
    assert {(r["pre"], r["post"]): r["weight"] for r in merged_edges(spark, str(tmp_path / "out")).collect()} == {(1, 2): 17, (2, 1): 1}


def test_pull_with_its_converter(spark, tmp_path):
    from axonframe.sources.registry import Registry, pull, store_converter
    from axonframe.sources.store import Store

    (tmp_path / "c.csv").write_text("id,Completed\n7,True\n8,True\n")
    (tmp_path / "e.csv").write_text("Presynaptic_ID,Postsynaptic_ID,Connectivity,Excitatory\n7,8,12,-1\n")
    files = [{"name": f"{r}.csv", "url": (tmp_path / f"{r[0] if r == 'completeness' else 'e'}.csv").as_uri(), "role": r} for r in ("completeness", "connectivity")]
    registry = Registry()
    registry.add({"name": "shiu", "version": "630", "files": files})
    registry.add({"name": "other", "version": "1", "files": files})
    cache = str(tmp_path / "cache")
    root = pull(registry.get("shiu@630"), cache, store_converter(spark))
    store = Store(spark, str(root))
    assert [(r["pre"], r["post"], r["weight"]) for r in store.edges().collect()] == [(7, 8, 12)]
    assert {r["neuron_id"]: r["nt_pred"] for r in store.neurons().collect()} == {7: "gaba", 8: None}
    with pytest.raises(KeyError):
        pull(registry.get("other@1"), cache, store_converter(spark))
