import random

import numpy as np
import xxhash

from axonframe.llm import simhash as s


def brute_print(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    hs = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def test_golay_keys_cover_two_bits():
    rng = random.Random(1)
    words = np.array([rng.getrandbits(23) for _ in range(300)], np.int64)
    at, index = s.codeword_indices(words)
    keys = [set(index[at == i].tolist()) for i in range(len(words))]
    assert max(map(len, keys)) <= 6
    for w, k in zip(words.tolist(), keys, strict=True):
        near = np.array([w ^ (1 << rng.randrange(23)) ^ (1 << rng.randrange(23)) for _ in range(5)], np.int64)
        at, index = s.codeword_indices(near)
        for j in range(5):
            assert k & set(index[at == j].tolist())


def test_all_near_pairs_share_a_key():
    rng = random.Random(2)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, 2)):
            b ^= 1 << bit
        keys = []
        for x in (a, b):
            _, k = s.golay_keys(np.array([x], np.uint64).view(np.int64))
            keys.append(set(k.tolist()))
        assert keys[0] & keys[1]


def _root(par, x):
    while par[x] != x:
        x = par[x]
    return x


def _brute_components(values):
    par = {v: v for v in values}
    vs = sorted(values)
    for i, a in enumerate(vs):
        for b in vs[i + 1 :]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 2:
                x, y = _root(par, a), _root(par, b)
                par[max(x, y)] = min(x, y)
    return {v: _root(par, v) for v in vs}


def test_links_connect_like_all_pairs_with_large_groups(spark):
    """A dense ball of fingerprints makes keys with more members than are paired."""
    rng = random.Random(3)
    center = rng.getrandbits(63)
    values = {center ^ (1 << i) ^ (1 << j) for i in range(16) for j in range(i + 1)} | {rng.getrandbits(63) for _ in range(100)}
    chain = rng.getrandbits(63)
    for i in range(20):
        values.add(chain)
        chain ^= (1 << (2 * i)) | (1 << (2 * i + 1))
    want = _brute_components(values)
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    for limit in (2, 24, 10_000):
        found = {r["node"]: r["root"] for r in s.components(s.links(fps, pair_limit=limit)).collect()}
        assert {v: found.get(v, v) for v in values} == want


def test_near_duplicates_odd_rows(spark, make, odd_rows):
    got = s.near_duplicates(make(odd_rows)).collect()
    assert len(got) == len(odd_rows)
    prints = {f"{brute_print(t):016x}" for _, t, *_ in odd_rows}
    assert {r["fingerprint"] for r in got} == prints
    by = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in got}
    assert by[None, f"{brute_print(odd_rows[0][1]):016x}"] == 1
    assert {by[i, "0" * 16] for i in (2, 3, 4)} == {2}
    assert s.near_duplicates(make([])).count() == 0


def brute_groups(docs, n=5, similarity=0.8):
    """Index of the first document of each row's group, from all pairs."""
    sets = []
    for t in docs:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    par = {i: i for i in range(len(docs))}
    for i, a in enumerate(sets):
        for j in range(i + 1, len(sets)):
            both = len(a & sets[j])
            if a == sets[j] or both and both >= similarity * (len(a) + len(sets[j]) - both):
                x, y = _root(par, i), _root(par, j)
                par[max(x, y)] = min(x, y)
    return [_root(par, i) for i in range(len(docs))]


def _edited(rng, words, edits):
    w = list(words)
    for _ in range(edits):
        at = rng.randrange(len(w))
        w[at : at + rng.choice([0, 1, 1])] = [f"new{rng.random()}"]
    return w


def test_first_of_groups_equals_all_pairs(spark, make):
    rng = random.Random(8)
    docs = []
    for g in range(25):
        base = [f"g{g}w{i}" for i in range(rng.choice([60, 120, 300]))]
        docs.append(base)
        docs += [_edited(rng, base, rng.choice([0, 1, 1, 2, 3, 5, 9])) for _ in range(rng.choice([1, 2, 8]))]
    hot = [f"hot{i}" for i in range(200)]
    docs += [_edited(rng, hot, rng.choice([1, 1, 2])) for _ in range(150)]
    docs += [[f"only{i}x{j}" for j in range(40)] for i in range(20)] + [["a", "b"], ["a", "b"], []]
    texts = [" ".join(w) for w in docs]
    order = list(range(len(texts)))
    rng.shuffle(order)
    texts = [texts[i] for i in order]
    want = {i for i, r in enumerate(brute_groups(texts)) if i == r}
    for limit in (s.PAIR_LIMIT, 3):
        s.PAIR_LIMIT, keep = limit, s.PAIR_LIMIT
        kept = {r["doc_id"] for r in s.first_of_groups(make(list(enumerate(texts)))).collect()}
        s.PAIR_LIMIT = keep
        assert kept == want


def test_large_keys_of_several_cores(spark, make):
    """Near copies of several cores with a text in common, in chains, with keys far above the limit of pairs: every
    group of all pairs is found."""
    rng = random.Random(12)
    shared = [f"s{i}" for i in range(60)]
    texts = []
    for core in range(6):
        w = shared + [f"c{core}w{i}" for i in range(70)]
        for step in range(160):
            texts.append(" ".join(_edited(rng, w, rng.choice([1, 1, 2, 3]))))
            if step % 20 == 19:
                w = _edited(rng, w, 2)
    rng.shuffle(texts)
    want = {i for i, r in enumerate(brute_groups(texts)) if i == r}
    kept = {r["doc_id"] for r in s.first_of_groups(make(list(enumerate(texts)))).collect()}
    print("groups", len(want), "kept", len(kept), "lost links", len(kept - want))
    assert kept == want


def _classes(spark, docs):
    """Documents and their classes, all with the same two keys."""
    sets = s.shingle_sets([t.encode() for t in docs], 5)
    marks = s.parity_marks(sets)
    rows = [(s.set_class(x), i, [1, 2], [int(v) for v in m]) for i, (x, m) in enumerate(zip(sets, marks, strict=True))]
    return spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(rows, "fp long, least long, keys array<long>, mark array<long>")


def test_a_large_key_loses_no_link(spark):
    """120 classes share all keys, only couples and threes of them are similar, so no leader is like the others."""
    rng = random.Random(4)
    docs = []
    for g in range(50):
        base = [f"g{g}w{i}" for i in range(80)]
        docs += [" ".join(base)] + [" ".join(_edited(rng, base, 1)) for _ in range(1 + g % 2)]
    rng.shuffle(docs)
    want = brute_groups(docs)
    frame, classes = _classes(spark, docs)
    fps = {r["least"]: r["fp"] for r in classes.collect()}
    for options in ({}, {"cell_bytes": 4000}):
        found = {r["node"]: r["root"] for r in s.components(s.similar_links(frame, classes, id_col="doc_id", text_col="text", shingle=5, similarity=0.8, **options)).collect()}
        groups = [found.get(fps[i], fps[i]) for i in range(len(docs))]
        assert len(set(zip(groups, want, strict=True))) == len(set(groups)) == len(set(want)) == 50


def test_cells_hold_all_pairs_of_different_roots(spark):
    """Whatever a key's size, its pairs of different roots meet, no cell is much larger than two blocks, and a key whose
    others fit in one block gives each class to few cells."""
    rows = [(k, 1000 * k + i, 10, -1 if i < 300 else i // 4) for k in (1, 2) for i in range(300 + (60 if k == 1 else 4))] + [(3, i, 10, 7) for i in range(50)]
    cells = s._cells(spark.createDataFrame(rows, "key long, fp long, size long, root long"), 1600).groupBy("cell").agg(s.F.collect_set(s.F.struct("fp", "root")).alias("m")).collect()
    met = {(x["fp"], y["fp"]) for r in cells for x in r["m"] for y in r["m"] if x["root"] != y["root"]}
    assert met == {(x[1], y[1]) for x in rows for y in rows if x[0] == y[0] and x[3] != y[3]}
    assert max(len(r["m"]) for r in cells) <= 2 * 2 * 1600 // 80
    assert sum(len([x for x in r["m"] if x["fp"] // 1000 == 2]) for r in cells) <= 304 + 4 * 15


def test_cell_links_connect_like_all_pairs():
    rng = random.Random(6)
    bases = [[f"g{g}w{i}" for i in range(rng.choice([20, 60]))] for g in range(12)]
    docs = [" ".join(_edited(rng, rng.choice(bases), rng.choice([0, 1, 2, 4]))) for _ in range(150)]
    docs = list(dict.fromkeys(docs))
    sets, roots = s.shingle_sets([t.encode() for t in docs], 5), s.np.arange(len(docs)) // 2
    par = dict(enumerate(range(len(docs))))
    for i, a in enumerate(map(set, sets)):
        for j, b in enumerate(map(set, sets[:i])):
            if roots[i] == roots[j] or len(a & b) >= 0.8 * len(a | b):
                x, y = _root(par, i), _root(par, j)
                par[max(x, y)] = min(x, y)
    got = dict(enumerate(range(len(docs))))
    found = s.cell_links(sets, roots, 0.8)
    assert len(found) < len(docs)
    for i, j in [*found, *((i, i - 1) for i in range(1, len(docs), 2))]:
        assert roots[i] == roots[j] or len({*sets[i]} & {*sets[j]}) >= 0.8 * len({*sets[i]} | {*sets[j]})
        x, y = _root(got, i), _root(got, j)
        got[max(x, y)] = min(x, y)
    assert [_root(got, i) for i in got] == [_root(par, i) for i in par]


def test_first_of_groups_odd_rows(spark, make, odd_rows):
    kept = s.first_of_groups(make(odd_rows)).collect()
    assert sorted(r["doc_id"] for r in kept) == [1, 2, 5, 6]
    rows = [(None, "a b c d"), (None, "a b c d"), (None, "x y z w q"), (7, "x y z w q"), (8, "one text of its own here"), (8, "and one more with this id"), (8, "one text of its own here")]
    alone = s.first_of_groups(make(rows)).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in alone) == [(0, "a b c d"), (7, "x y z w q"), (8, "and one more with this id"), (8, "one text of its own here")]
    assert s.first_of_groups(make([])).count() == 0
