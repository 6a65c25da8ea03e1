import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from axonframe.llm import lm_score as m


def _model_parts(texts, blocks):
    flat = m.flatten(texts)
    g = m._runs(np.concatenate([k for _, k in m.grams(flat)]))
    w = m._runs(m.tokens(flat)[1])
    one = m._runs(np.unique(g[0] & np.uint64(0xFFFFFF)) & np.uint64(0xFFFF))
    low = [m._runs(one[0] & np.uint64(0xFF)), one]
    for b in range(blocks):
        at = m.block_of_gram(g[0], blocks) == b
        wt = m.block_of_word(w[0], blocks) == b
        yield m.make_block(b, blocks, (w[0][wt], w[1][wt]), (g[0][at], g[1][at]), low)


def test_probabilities_sum_to_one_in_every_context():
    rng = np.random.default_rng(0)
    texts = [bytes(rng.choice(list(b"abcd e"), 150).tolist()) for _ in range(20)]
    for blocks in (1, 3):
        parts = list(_model_parts(texts, blocks))
        for ctx in (b"abcde", b"zzzab", b"qqqqq", bytes([m._PAD] * 4) + b"a", b"e zab"):
            key = int.from_bytes(ctx, "big") << 8
            keys = np.array([key | s for s in range(256)], np.uint64)
            block = parts[int(m.block_of_gram(keys[:1], blocks)[0])]
            assert abs((10.0 ** m.code_lengths(block, keys)).sum() - 1) < 1e-9


def test_blocks_agree_and_base_equals_brute_force(spark, make, odd_rows):
    docs = make([*odd_rows, *((100 + i, f"the cat number {i} sat on the mat {i % 3}") for i in range(40))]).withColumn("held_out", m.held_out(F.col("doc_id")))
    train = docs.where(~F.col("held_out"))
    got = {}
    for rows in (10**9, 500):
        model = m.fit(train, block_rows=rows)
        got[rows] = sorted(((r["doc_id"] or -1), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 3)) for r in m.score_texts(docs, model, id_cols=["doc_id", "held_out"]).collect())
        assert (len(model.blocks) > 1) == (rows == 500)
    assert got[10**9] == got[500]
    words = lambda t: (t or "").encode().lower().split()
    c = Counter()
    for r in train.collect():
        c.update([*words(r["text"]), None])
    n, v = sum(c.values()), len(c)
    want = []
    for r in docs.collect():
        t = [*words(r["text"]), None]
        want.append((r["doc_id"] or -1, len(t), sum(c[x] > 0 for x in t), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in t), 3)))
    assert got[500] == sorted(want)


def test_scores_do_not_depend_on_blocks(spark, make):
    rng = np.random.default_rng(1)
    docs = make([(i, " ".join(rng.choice(["cat", "dog", "mat", "sat", "hat", "catalog", "dogma", "xyz"], 12))) for i in range(60)])
    got = {}
    for rows in (10**9, 40):
        model = m.fit(docs.where("doc_id < 40"), block_rows=rows)
        got[rows] = {r["doc_id"]: r["score"] for r in m.score_texts(docs, model, id_cols=["doc_id"]).collect()}
        assert (len(model.blocks) > 1) == (rows == 40)
    assert all(abs(got[40][i] - x) < 1e-9 * abs(x) for i, x in got[10**9].items())


def test_known_text_scores_better_and_empty_training(spark, make):
    docs = make([(i, "some repeated training sentence about cats and dogs") for i in range(30)])
    model = m.fit(docs)
    rows = {r["doc_id"]: r for r in m.score_texts(make([(1, "training sentence about cats"), (2, "xq zvj wkp qqx jjzk vvwx qkz")]), model, id_cols=["doc_id"]).collect()}
    assert rows[1]["score"] > rows[2]["score"]
    none = m.fit(make([]))
    r = m.score_texts(make([(1, "abc"), (2, None)]), none, id_cols=["doc_id"]).orderBy("doc_id").collect()
    assert abs(r[0]["score"] + 4 * math.log10(256)) < 1e-9 and r[0]["n_known"] == 0 and r[1]["n_tokens"] == 1
    assert m.score_texts(make([]), model, id_cols=["doc_id"]).count() == 0
