import math
import random

from pyspark.sql import functions as F

from axonframe.llm import mixing


def _targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        w = sum(weight[s] for s in free)
        share = {s: left * weight[s] / w for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return {**{s: 3.0 * sizes[s] for s in capped}, **share}
        capped |= over


def test_targets_and_taken(spark, make, odd_rows):
    rng = random.Random(0)
    rows = [(i, " ".join(["w"] * rng.randint(0, 60)), None, rng.choice(["a", "b", "c", "d", "e", None, "tiny"] + ["hot"] * 8)) for i in range(600)]
    rows = [r if r[3] != "tiny" or r[0] < 60 else (*r[:3], "a") for r in rows] + odd_rows
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = _targets(sizes)
    for limit, bits in ((4096, 10), (16, 2)):
        mixing.BUCKET_ROWS, mixing.GROUP_BITS = limit, bits
        got = mixing.mix_sources(make(rows)).collect()
        assert len(got) == len(rows)
        for s in sizes:
            mine = [r for r in got if r["source"] == s]
            assert all(abs(r["target"] - want[s]) < 1e-6 and r["source_size"] == sizes[s] for r in mine)
            assert abs(sum(r["taken"] for r in mine) - want[s]) <= 2
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
        key = lambda x: sorted((r["doc_id"] or -1, r["size"], r["taken"]) for r in x)
        assert key(got) == key(mixing.mix_sources(make(rows).repartition(7)).collect())
    mixing.BUCKET_ROWS, mixing.GROUP_BITS = 128, 10


def test_keep_ordered_and_empty(spark, make, odd_rows):
    mixed = mixing.mix_documents(make(odd_rows).withColumn("mix_key", F.lit("clash")))
    assert mixed.columns[:7] == make([]).columns and mixed.columns.count("mix_key") == 1
    finish = [r["mix_finish"] for r in mixed.collect()]
    assert finish == sorted(finish) and finish
    assert mixing.mix_sources(make([])).count() == 0
    assert [r["taken"] for r in mixing.mix_sources(make([(1, None), (2, "")])).collect()] == [0, 0]


def test_order_equals_exact_finish_times(spark, make):
    """Skewed sizes and repeated passes, against cumulative words in plain Python."""
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * (rng.choice([400, 900]) if i % 9 == 0 else rng.randint(0, 20))), None, "abc"[i % 11 % 3] if i % 11 else "d") for i in range(300)]
    sized = mixing._sized(make(rows), "doc_id", "text", "source")
    key = {r["doc_id"]: r["key"] for r in sized.collect()}
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want = []
    for s, target in _targets(sizes).items():
        left, clock, turn = math.ceil(target - 1e-6), 0, 0
        while left > 0:
            for i, t, _, _ in sorted((r for r in rows if r[3] == s and r[1]), key=lambda r: key[r[0]]):
                n = len(t.split())
                clock += n
                want.append((clock / target if left > n else 1.0, key[i], i, turn, min(n, left)))
                left -= n
                if left <= 0:
                    break
            turn += 1
    left, cut = sum(sizes.values()), []
    for w in sorted(want):
        if left:
            cut.append((*w[:4], min(w[4], left)))
            left -= cut[-1][4]
    assert sum(w[4] for w in want) > sum(w[4] for w in cut)
    want = cut
    assert max(w[3] for w in want) >= 1
    for limit, bits in ((4096, 10), (16, 2)):
        mixing.BUCKET_ROWS, mixing.GROUP_BITS = limit, bits
        got = [tuple(r[c] for c in ("mix_finish", "mix_key", "doc_id", "mix_pass", "mix_taken")) for r in mixing.mix_documents(make(rows)).collect()]
        assert [g[1:] for g in got] == [w[1:] for w in want]
        assert all(abs(g[0] - w[0]) < 1e-9 for g, w in zip(got, want, strict=True))
    mixing.BUCKET_ROWS, mixing.GROUP_BITS = 128, 10
    assert sum(w[4] for w in want) == sum(sizes.values())


def test_cut_anywhere_in_the_stream(spark):
    """A budget that ends inside, at the end of and beyond any row, over many range partitions and in one."""
    rng = random.Random(5)
    rows = [("ab"[i % 2], rng.randrange(1 << 40), 9, i % 3, rng.choice([1, 1, 3]), rng.randrange(8) / 8, rng.randint(1, 9)) for i in range(400)]
    stream = spark.createDataFrame(rows, "source string, key long, size long, pass int, n long, finish double, words long").repartition(7)
    for total in (0, 1, 700, sum(r[4] * r[6] for r in rows) - 1, 10**6):
        want, left = [], total
        for r in sorted(rows, key=lambda r: (r[5], r[1], r[3])):
            words = min(r[6], left // r[4])
            left = max(0, left - r[4] * r[6])
            want += [(r[1], words)] * (words > 0)
        for aqe in ("true", "false"):
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", aqe)
            got = mixing.cut_at_budget(stream, total)
            assert sorted((r["key"], r["words"]) for r in got.collect()) == sorted(want)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
