import re
from collections import Counter

from pyspark.sql import functions as F

from axonframe.llm import quality, registry
from tests.llm.conftest import SENTENCE

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    cover = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover)


def test_counts_equal_brute_force(spark, make, odd_rows):
    texts = ["a b c a b c a b c", "x x x x", "a b c d a b c", "one\ntwo\none\n\n \none", "# * $ % & | < > ok", " ".join(f"w{i}" for i in range(60)), "\n".join([SENTENCE] * 5), " ".join(f"p{i % 7} q{i % 11}" for i in range(900))]
    rows = [*odd_rows, *((50 + i, t) for i, t in enumerate(texts))]
    got = sorted((r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in quality.quality_rules(make(rows)).collect())
    assert got == sorted(brute(t) for _, t, *_ in rows)
    assert quality.quality_rules(make([])).count() == 0
    plain = make([r for r in rows if len((r[1] or "").split()) > 3]).select(quality.let(quality.words(F.col("text")), quality._repeat_words_by_text).alias("n"))
    assert sorted(r["n"] for r in plain.collect()) == sorted(brute(t)[4] for _, t, *_ in rows if len((t or "").split()) > 3)


def test_clean_text_is_kept_and_junk_is_not(spark, make):
    clean = " ".join(f"the {w}{i} of house{i} was tree{i}," for i, w in enumerate(SENTENCE.split() * 4))
    docs = make([(1, clean), (2, clean.replace(" ", "### ")), (3, clean.upper()), (4, "\n".join(["and the same line again"] * 30)), (5, " | ".join(f"item{i}" for i in range(80)))])
    good = {r["doc_id"]: r["good"] for r in quality.quality_rules(docs).collect()}
    assert good == {1: True, 2: False, 3: False, 4: False, 5: False}


def test_registered_query_has_no_user_functions(spark, tmp_path, make):
    make([(1, SENTENCE)]).write.parquet(f"{tmp_path}/documents.parquet")
    plan = registry.op4_quality(spark, str(tmp_path))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)
