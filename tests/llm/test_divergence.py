import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from axonframe.llm import divergence


def _terms(text):
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def _expected(rows):
    rows = [(t or "", lang or "", source or "") for _, t, lang, source in rows]
    out = []
    for lang in {r[1] for r in rows}:
        docs, groups = Counter(), defaultdict(Counter)
        for t, g, s in rows:
            if g == lang:
                groups[s].update(_terms(t))
                docs.update(set(_terms(t)))
        kept = [w for w, n in docs.items() if n >= 3]

        def shares(count):
            total = sum(count[w] for w in kept)
            return {w: 1 + 10**9 * (count[w] + 1) // (total + len(kept)) for w in kept}

        q = shares(sum(groups.values(), Counter()))
        for s, count in groups.items():
            p = shares(count)
            pairs = [(-sum((p[w] - o[w]) ** 2 // o[w] for w in kept), item.encode(), item) for item, c in groups.items() if item != s for o in [shares(c)]]
            terms = [(-((p[w] - q[w]) ** 2 // q[w]), w.encode(), w) for w in kept if count[w] and p[w] > q[w]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:200])):
                out += [(lang, s, part, item, -v, k) for k, (v, _, item) in enumerate(found, 1)]
    return sorted(out)


def _got(docs):
    return sorted(map(tuple, divergence.source_divergence(docs).select("lang", "source", "part", "item", "value", "rank").collect()))


def test_equals_brute_force(spark, make):
    rng = random.Random(3)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)] + ["Ünï", "日本", "É", "é"]
    rows = []
    for i in range(260):
        source = rng.choice(["hot"] * 5 + ["b", "c", None, "日"])
        pool = words if source == "hot" else rng.sample(words, 60)
        rows.append((i, " ".join(x.title() if rng.random() < 0.3 else x for x in rng.choices(pool, k=rng.randint(0, 80))), rng.choice(["en"] * 4 + ["fr", None]), source))
    want = _expected(rows)
    assert max(r[5] for r in want if r[2] == "term") == 200
    assert _got(make(rows)) == want


def test_odd_rows(spark, make, odd_rows):
    rows = [(*r, *[None] * (4 - len(r)))[:4] for r in odd_rows] + [(10, "x1y_z", "zz", "p"), (11, "", "zz", "q"), (12, None, "yy", None)]
    assert _got(make(rows).withColumn("term", F.lit("clash")).withColumn("salt", F.lit(1))) == _expected(rows)
    assert divergence.source_divergence(make([])).count() == 0


def test_shares_are_exact_for_large_counts(spark):
    (row,) = spark.range(1).select(divergence.share(F.lit(9_000_000_000_000_000).cast("long"), F.lit(9_200_000_000_000_001).cast("long"), F.lit(77).cast("long")).alias("p")).collect()
    assert row["p"] == 1 + 10**9 * (9_000_000_000_000_000 + 1) // (9_200_000_000_000_001 + 77)
