"""The pipeline on a small fixture against a plain run of its stages, and registration."""

import importlib.util
import random

import corpus_pipeline
from axonframe.llm import decontaminate, registry
from axonframe.llm.secrets import find_spans, redact, vocabulary_ranks
from tests.llm.test_simhash import brute_groups


def _fixture(spark, tmp_path):
    rng = random.Random(5)
    vocab = {"en": ["the", "and", "of", "thing", "tion", "whole", "early"], "de": ["der", "und", "sch", "keit", "über", "ein", "zeit"]}
    text = lambda k, n: " ".join(rng.choice(vocab[k]) + rng.choice(vocab[k]) for _ in range(n))
    items = [(i, " ".join(f"bench{i}x{j}" for j in range(15))) for i in range(3)]
    rows = [(i, text(k, 60), k, f"s{i % 3}") for i, k in enumerate(["en", "de"] * 30)]
    rows += [(100, rows[0][1], "en", "s0"), (101, rows[4][1] + " end", "en", "s1"), (102, f"{text('en', 30)} {items[1][1]} {text('en', 30)}", "en", "s2")]
    rows += [(103, f"{text('de', 40)} token = abcdef0123456789 {text('de', 40)}", "de", "s0"), (104, None, "en", "s1"), (105, "123 456", None, None)]
    d = str(tmp_path)
    spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, rows, items


def test_stages(spark, tmp_path):
    d, rows, items = _fixture(spark, tmp_path)
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, d).collect()}
    lettered = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    lettered.sort()
    groups = brute_groups([r[1] for r in lettered])
    first = [r[0] for i, r in enumerate(lettered) if groups[i] == i]
    clean = [i for i in first if not any(t in next(r[1] for r in rows if r[0] == i) for _, t in items)]
    assert set(got) <= set(clean)
    assert len(got) >= 0.3 * len(clean)
    assert not {100, 101, 102, 104, 105} & set(got)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, d)
        assert out.columns == docs.columns, name
        kept = {r["doc_id"]: r["text"] for r in out.collect()}
        if name == "language":
            assert len(kept) >= len(lettered) - 2
    assert set(kept) == set(clean)
    for i, t in kept.items():
        source = next(r[1] for r in rows if r[0] == i)
        assert t == redact(source, find_spans(source, rank=vocabulary_ranks()))


def _write(spark, folder, rows, items):
    spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, mix_key string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_odd_rows_through_all_stages(spark, tmp_path):
    """Null id, null source, repeated rows, a very long text, columns with clashing names."""
    rng = random.Random(9)
    text = lambda n: " ".join(rng.choice(["the", "and", "of", "thing", "whole", "early"]) + str(rng.choice("abcdefgh")) for _ in range(n))
    rows = [(i, text(50), "en", "s0", 1) for i in range(30)] + [(None, text(60), None, None, None), (50, text(40_000), "en", None, 1), (50, None, None, None, None)]
    rows += [rows[0], rows[0], (60, "", "en", "s0", 0)]
    _write(spark, tmp_path, rows, [(1, None), (2, "")])
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in got} <= {*range(30), None, 50}
    assert sum(r["doc_id"] == 0 for r in got) <= 3 and all(r["mix_taken"] > 0 for r in got)


def test_empty_tables(spark, tmp_path):
    _write(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered():
    assert [k for k, _ in corpus_pipeline.STAGES] == ["language", "near_dedup", "decontamination", "secret_scan", "mix"]
    assert sorted(int(k[2:].split("_")[0]) for k in registry.queries()) == list(range(1, 14))
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert importlib.util.find_spec("__spark_entry__") is not None
    assert decontaminate.MIN_SCORE <= 0.8
