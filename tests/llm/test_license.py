import random

from axonframe.llm import license_scan as l
from tests.llm.conftest import SENTENCE


def test_found_and_clean(spark, make, odd_rows):
    pad = " ".join(f"pad{i}" for i in range(200))
    mit = l.TEMPLATES["MIT-text"].split()
    mit[7] = "WHATEVER"
    docs = [(10 + i, f"{pad}\n{t.upper()}.\n{pad}") for i, t in enumerate(l.TEMPLATES.values())]
    docs += [(40, f"{pad} {' '.join(mit)} {pad}"), (41, f"{pad} licensed under the {pad}"), *odd_rows]
    got = {(r["doc_id"], r["license"]) for r in l.scan_licenses(spark, make(docs)).collect()}
    for i, k in enumerate(l.TEMPLATES):
        assert (10 + i, k) in got
    assert not [x for x in got if x[0] is None or x[0] < 10 or x[0] == 41]
    assert l.scan_licenses(spark, make([])).count() == 0
    assert l.scan_licenses(spark, make(docs), templates={"short": "two words"}).count() == 0


def test_very_common_notice(spark, make):
    docs = make([(i, f"{SENTENCE} {i}\nReleased under the MIT License.") for i in range(300)])
    got = l.scan_licenses(spark, docs).collect()
    assert {(r["doc_id"], r["license"]) for r in got} == {(i, "MIT") for i in range(300)}


def test_recall_of_templates_held_in_part(spark, make):
    """Templates of every size, each with edits that leave about 0.8 and more of its shingles, among other words."""
    rng = random.Random(1)
    templates = {f"t{n}_{i}": " ".join(f"w{n}x{i}y{j}" for j in range(n + 4)) for n in (1, 2, 5, 17, 40, 65, 250) for i in range(4)}
    docs, want = [], set()
    for k, text in templates.items():
        for copy in range(25):
            w = text.split()
            n = len(w) - 4
            for at in rng.sample(range(len(w)), n // 25):
                w[at] = "edited"
            left = sum("edited" not in w[j : j + 5] for j in range(n))
            pad = [f"pad{rng.random()}" for _ in range(rng.randint(0, 300))]
            docs.append((len(docs), " ".join([*pad, *w, *pad[:50]])))
            if left >= 0.8 * n:
                want.add((docs[-1][0], k))
    found = {(r["doc_id"], r["license"]) for r in l.scan_licenses(spark, make(docs), templates=templates).collect()}
    assert found <= want and len(found) >= 0.995 * len(want) and len(want) > 500


def test_null_and_repeated_ids(spark, make):
    rows = [(None, "x y z\nReleased under the MIT License."), (5, "Released under the MIT License."), (5, "Released under the MIT License."), (5, None), (6, "a b")]
    assert {(r["doc_id"], r["license"]) for r in l.scan_licenses(spark, make(rows)).collect()} == {(None, "MIT"), (5, "MIT")}
