import numpy as np
import pytest

from axonframe.llm import decontaminate as d


def brute_align(item, passage):
    h = [[0] * (len(passage) + 1) for _ in range(len(item) + 1)]
    best = 0
    for i in range(1, len(item) + 1):
        for j in range(1, len(passage) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if item[i - 1] == passage[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


def test_align_equals_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(60):
        a, b = rng.integers(0, 5, rng.integers(1, 12)), rng.integers(0, 5, rng.integers(0, 30))
        score, start, end = d.align(a.astype(np.uint64), b.astype(np.uint64))
        assert score == brute_align(a.tolist(), b.tolist()) == brute_align(a.tolist(), b.tolist()[start:end])


@pytest.fixture
def items(spark):
    rows = [(i, " ".join(f"item{i}word{j}" for j in range(20))) for i in range(12)]
    return rows, spark.createDataFrame([*rows, (90, None), (91, ""), (92, "solo token")], "item_id long, text string")


def test_copies_and_edited_copies(spark, make, items):
    rows, frame = items
    pad = " ".join(f"pad{i}" for i in range(40))
    copy = rows[0][1]
    edited = copy.split()
    edited[3:5] = ["other", "words", "here"]
    del edited[15]
    docs = [
        (1, f"{pad} {copy.upper()}, {pad}"),
        (2, f"{pad} {' '.join(edited)} {pad}"),
        (3, f"{pad} {' '.join(copy.split()[:6])} {pad}"),
        (4, pad),
        (5, None),
        (None, copy),
        (7, "x solo, TOKEN y"),
        (8, f"{rows[3][1]} {pad} {rows[4][1]}"),
        (8, f"{rows[3][1]} {pad} {rows[4][1]}"),
    ]
    found = {(r["doc_id"], tuple(x["item_id"] for x in r["leaks"])) for r in d.find_leaks(make(docs), frame).collect()}
    assert found == {(1, (0,)), (2, (0,)), (3, ()), (4, ()), (5, ()), (None, (0,)), (7, (92,)), (8, (3, 4))}
    in_blocks = {(r["doc_id"], tuple(sorted(x["item_id"] for x in r["leaks"]))) for r in d.find_leaks(make(docs), frame, broadcast_words=20).collect()}
    assert in_blocks == found


def test_spread_edits_equal_brute_force(spark, make, items):
    """Copies with one word in k replaced, or words inserted, against an alignment with the whole document."""
    rng = np.random.default_rng(4)
    rows, frame = items
    docs = []
    for i, (_, text) in enumerate(rows):
        for k in (4, 5, 6, 7):
            w = text.split()
            for at in range(i % k, len(w), k):
                w[at] = f"edit{i}k{k}at{at}"
            docs.append(w)
        w = text.split()
        at = int(rng.integers(5, 15))
        docs.append(w[:at] + [f"new{i}x{j}" for j in range(int(rng.integers(8, 22)))] + w[at:])
    docs = [[f"pad{n}x{j}" for j in range(30)] + w + [f"end{n}x{j}" for j in range(30)] for n, w in enumerate(docs)]
    want = set()
    for n, w in enumerate(docs):
        for i, text in rows:
            v = text.split()
            runs = {tuple(v[j : j + d.SEED_WORDS]) for j in range(len(v))} & {tuple(w[j : j + d.SEED_WORDS]) for j in range(len(w) - d.SEED_WORDS + 1)}
            score = brute_align(v, w) / (2 * len(v)) if runs else 0.0
            if score >= d.MIN_SCORE:
                want.add((n, i, score))
    assert len(want) > len(docs) * 0.6
    for limit in (d.BROADCAST_WORDS, 20):
        found = d.find_leaks(make([(n, " ".join(w)) for n, w in enumerate(docs)]), frame, broadcast_words=limit).collect()
        assert {(r["doc_id"], x["item_id"], x["score"]) for r in found for x in r["leaks"]} == want
        for r in found:
            for x in r["leaks"]:
                assert brute_align(rows[x["item_id"]][1].split(), docs[r["doc_id"]][x["first_word"] : x["end_word"]]) == 40 * x["score"]


def test_edited_copies_at_all_offsets(spark, make, items):
    """One word in 6 to 10 replaced, at every offset: all copies are found."""
    rows, frame = items
    docs, want = [], set()
    for i, text in rows:
        for k in (6, 7, 8, 9, 10):
            for offset in range(k):
                w = text.split()
                for at in range(offset, len(w), k):
                    w[at] = f"edit{at}"
                want.add((len(docs), i))
                docs.append((len(docs), f"pad a b {' '.join(w)} c d pad"))
    found = d.find_leaks(make(docs), frame).collect()
    assert {(r["doc_id"], x["item_id"]) for r in found for x in r["leaks"]} == want


def test_ties_long_texts_and_clashing_columns(make, items):
    rows, frame = items
    long = " ".join(f"pad{i}" for i in range(60_000))
    docs = make([(1, f"{rows[2][1]} {long} {rows[2][1]}"), (2, f"{long} {rows[3][1]}")]).withColumnRenamed("extra", "leaks")
    for limit in (d.BROADCAST_WORDS, 20):
        out = d.find_leaks(docs, frame, broadcast_words=limit)
        assert out.columns.count("leaks") == 1
        got = {r["doc_id"]: r["leaks"] for r in out.collect()}
        assert [(x["item_id"], x["first_word"], x["end_word"]) for x in got[1]] == [(2, 0, 20)]
        assert [(x["item_id"], x["first_word"], x["end_word"]) for x in got[2]] == [(3, 60_000, 60_020)]


def test_very_common_passage_and_empty_tables(spark, make, items):
    rows, frame = items
    docs = make([(i, f"a{i} b{i} {rows[5][1]} c{i}") for i in range(200)])
    assert all([x["item_id"] for x in r["leaks"]] == [5] and r["leaks"][0]["score"] == 1.0 for r in d.find_leaks(docs, frame).collect())
    assert d.find_leaks(make([]), frame).count() == 0
    assert all(r["leaks"] == [] for r in d.find_leaks(docs, frame.limit(0)).collect())
