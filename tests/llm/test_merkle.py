import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from axonframe.llm import merkle


def _h(x):
    return hashlib.sha256(x.encode()).hexdigest()


def _leaf(i, source, lang, n, text):
    return _h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))


def _tree(nodes):
    """Root and, for each node, its siblings (left, right) level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, j in enumerate(at):
            lo = j // 8 * 8
            paths[k].append(("".join(nodes[lo:j]), "".join(nodes[j + 1 : lo + 8])))
            at[k] = j // 8
        nodes = [_h("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
    return nodes[0], paths


def _lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def _expected(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for lang in langs:
        mine = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is None, r[0] or 0, _leaf(r[0], r[3], r[2], r[4], r[1])))
        trees.append((mine, *_tree([_leaf(i, s, g, n, t) for i, t, g, s, n in mine])))
    root, up = _tree([t[1] for t in trees])
    out = []
    for (mine, sub, paths), above in zip(trees, up, strict=True):
        for (i, t, g, s, n), path in zip(mine, paths, strict=True):
            path = path + above
            changed = i is not None and zlib.crc32(str(i).encode()) % 3 == 0 and t is not None
            node = _leaf(i, s, g, n, _lower(t) if changed else t)
            for a, b in path:
                node = _h(a + node + b)
            out.append((i, _leaf(i, s, g, n, t), sub, root, _h("".join(a + b for a, b in path)), node, node == root))
    return sorted(out, key=repr)


def _got(docs):
    rows = merkle.manifest(docs, tampered=F.crc32(F.col("doc_id").cast("string")) % 3 == 0)
    assert rows.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, rows.collect()), key=repr)


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 9, "fr": 1}, {"en": 64, "de": 65, None: 8, "": 7}, {"en": 700, "fr": 513, "es": 512}, {f"l{i}": 1 + i % 3 for i in range(70)}])
def test_equals_brute_force(spark, make, sizes):
    rows, i = [], 0
    for lang, n in sizes.items():
        for _ in range(n):
            rows.append(((i * 7919) % 100_003, f"Text {i} é\U0001f600" if i % 5 else f"lower {i}", lang, f"s{i % 3}"))
            i += 1
    want = _expected([(*r, len(r[1])) for r in rows])
    assert _got(make(rows).repartition(5)) == want
    assert any(not w[-1] for w in want) or len(want) < 9


def test_small_blocks_recurse(spark, make, monkeypatch):
    """Blocks of one level make the recursion deep."""
    rows = [(i, f"Text {i}", "en" if i % 3 else "fr", "s") for i in range(600)]
    monkeypatch.setattr(merkle, "LEVELS", 1)
    monkeypatch.setattr(merkle, "BLOCK", 8)
    assert _got(make(rows)) == _expected([(*r, len(r[1])) for r in rows])


def test_odd_rows(spark, make, odd_rows):
    rows = odd_rows + [(9, "A" * 200_000, None, None)]
    want = _expected([(i, t, g, s, None if t is None else len(t)) for i, t, g, s in ((*r, *[None] * (4 - len(r)))[:4] for r in rows)])
    assert _got(make(rows).withColumn("pos", F.lit("clash")).withColumn("tree", F.lit(1))) == want
    assert merkle.manifest(make([])).count() == 0


def test_trees_span_partitions(spark, make):
    """A tree cut into many partitions has the places of one sort."""
    conf = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 16)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    rows = merkle.numbered(make([(i, "", "a" if i % 4 else "b") for i in range(300)]).select("doc_id", "lang"), "lang", F.col("doc_id"))
    for lang, ids in (("a", [i for i in range(300) if i % 4]), ("b", list(range(0, 300, 4)))):
        got = sorted((r["pos"], r["doc_id"], r["total"]) for r in rows.where(F.col("lang") == lang).collect())
        assert got == [(k, i, len(ids)) for k, i in enumerate(ids)]
    spark.conf.set("spark.sql.shuffle.partitions", conf)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", True)
