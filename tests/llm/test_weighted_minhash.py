import hashlib
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from axonframe.llm import weighted_minhash as wm
from axonframe.llm.registry import op11_fingerprints


def _words(text):
    return Counter(re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text)))


def _jaccard(a, b):
    a, b = _words(a), _words(b)
    return sum((a & b).values()) / sum((a | b).values()) if a or b else 1.0


def _texts(rng, n):
    vocabulary = [f"W{i}é" for i in range(120)]
    base = rng.choices(vocabulary, k=80)
    return [" ".join(base[: rng.randint(0, 80)] + rng.choices(vocabulary[: rng.choice([5, 60, 120])], k=rng.randint(0, 90))) for _ in range(n)]


def test_share_of_equal_samples_is_the_generalised_jaccard_similarity():
    rng, sampler, gaps, spread = random.Random(5), wm.Sampler(), [], []
    for _ in range(250):
        a, b = _texts(rng, 2)
        true = _jaccard(a, b)
        gaps.append(wm.likeness(sampler.fingerprint(a.encode()), sampler.fingerprint(b.encode())) - true)
        spread.append(true * (1 - true) / wm.SAMPLES)
    assert abs(np.mean(gaps)) < 0.01
    assert 0.5 < np.mean(np.square(gaps)) / np.mean(spread) < 1.5


def test_samples_follow_from_the_words_alone(monkeypatch):
    """Order, cache and chunks do not matter; weights do."""
    texts = [t.encode() for t in _texts(random.Random(6), 60)]
    whole = [wm.Sampler().fingerprint(t) for t in texts]
    assert all((wm.Sampler().fingerprint(b" ".join(reversed(t.split()))) == w).all() for t, w in zip(texts, whole, strict=True))
    monkeypatch.setattr(wm, "CACHE_WORDS", 90)
    monkeypatch.setattr(wm, "CHUNK_WORDS", 40)
    sampler = wm.Sampler()
    assert all((sampler.fingerprint(t) == w).all() for t, w in zip(texts, whole, strict=True))
    assert wm.likeness(sampler.fingerprint(b"a b"), sampler.fingerprint(b"a a a a a a a a b")) < 0.6
    assert wm.likeness(sampler.fingerprint(b"a b"), sampler.fingerprint(b"A\tB\n")) == 1


def test_quantiles_are_those_of_the_gamma_distribution():
    x = wm.gamma_quantiles(12)
    assert abs(x.mean() - 2) < 0.01 and abs(x.var() - 2) < 0.1 and (np.diff(x) > 0).all()


def _expected(rows):
    """Brute force of the edited texts in order of ids."""
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    out = []
    for k, (i, t) in enumerate(order):
        follow = order[(k + 1) % len(order)][1] or ""
        t = t or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + follow[:half]
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), t, edited, follow))
    return out


def test_edited_texts_over_partitions(spark, make):
    rng = random.Random(7)
    rows = [(i, t) for i, t in zip(rng.sample(range(10_000), 150), _texts(rng, 150), strict=True)] + [(20_000, "\U0001f600 ünï x y"), (20_001, None), (20_002, " \n"), (None, "last of all")]
    want, sampler = _expected(rows), wm.Sampler()
    for parts in (1, 7, 64):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", parts == 1)
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = {r["doc_id"]: r for r in wm.fingerprint_texts(make(rows)).collect()}
        assert len(got) == len(rows)
        for i, n, digest, t, edited, follow in want:
            r = got[i]
            prints = [sampler.fingerprint(x.encode()) for x in (t, edited, follow)]
            assert (r["n_chars"], r["edited_sha256"]) == (n, digest)
            assert bytes(r["fingerprint"]) == prints[0].tobytes() and bytes(r["edited_fingerprint"]) == prints[1].tobytes()
            assert r["near_edited"] == wm.likeness(*prints[:2]) and r["near_next"] == wm.likeness(prints[0], prints[2])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", True)
    spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_odd_rows(spark, make, odd_rows):
    rows = wm.fingerprint_texts(make(odd_rows).withColumn("fingerprint", F.lit("clash")).withColumn("part", F.lit(1))).collect()
    assert len(rows) == len(odd_rows)
    zeros = {r["doc_id"] for r in rows if not any(r["fingerprint"])}
    assert zeros == {2, 3, 4}
    same = [r for r in rows if r["doc_id"] == 1]
    assert same[0]["fingerprint"] == same[1]["fingerprint"]
    assert wm.fingerprint_texts(make([])).count() == 0
    (lone,) = wm.fingerprint_texts(make([(7, "Ab cd")])).collect()
    assert lone["edited_sha256"] == hashlib.sha256(b"Ab Ab").hexdigest() and lone["near_next"] == 1


def test_query_equals_brute_force(spark, make, tmp_path):
    rng = random.Random(8)
    rows = list(enumerate(_texts(rng, 40)))
    make(rows).write.parquet(f"file://{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in op11_fingerprints(spark, f"file://{tmp_path}").collect()}
    for i, n, digest, t, edited, follow in _expected(rows):
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (n, digest)
        assert r["fingerprint"] == wm.Sampler().fingerprint(t.encode()).tobytes().hex()
        assert abs(r["near_edited"] - _jaccard(t, edited)) < 0.25 and abs(r["near_next"] - _jaccard(t, follow)) < 0.25
