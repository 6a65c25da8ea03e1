import random

import pytest

from axonframe.llm import langid
from tests.llm.conftest import SENTENCE

PARTS = {"en": ["the", "ing", "tion", "and", "er", "ly", "wh", "of"], "de": ["der", "sch", "ung", "ein", "und", "keit", "ie", "ü"], "fr": ["eau", "ç", "ment", "qu", "les", "ai", "ou", "é"]}


def _text(rng, lang, n=40):
    return " ".join("".join(rng.choice(PARTS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_held_out_accuracy_and_rejection(spark, make, odd_rows):
    rng = random.Random(0)
    train = make([(i, _text(rng, k), k) for i, k in enumerate(list(PARTS) * 60)])
    model = langid.fit_language_model(train)
    test = [(i, _text(rng, k), k) for i, k in enumerate(list(PARTS) * 30)]
    got = langid.predict_language(make(test), model).collect()
    assert sum(r["lang_pred"] == r["lang"] for r in got) >= 0.98 * len(test)
    assert sum(r["lang_rejected"] for r in got) <= 0.05 * len(test)
    odd = langid.predict_language(make([*odd_rows, (9, "1234 !!! ###")]), model).collect()
    und = {r["text"] for r in odd if r["lang_pred"] == "und"}
    assert und == {None, "", " \n\t ", "1234 !!! ###"}
    assert all(r["lang_rejected"] for r in odd if r["lang_pred"] == "und")
    assert all(0 <= r["lang_score"] <= 1 for r in odd)
    assert langid.predict_language(make([]), model).count() == 0


def test_reruns_agree_and_no_labels(spark, make):
    rng = random.Random(1)
    train = make([(i, _text(rng, k), k) for i, k in enumerate(list(PARTS) * 20)])
    a, b = langid.fit_language_model(train), langid.fit_language_model(train)
    assert (a.table == b.table).all() and a.threshold == b.threshold
    none = langid.fit_language_model(make([(1, SENTENCE, None)]))
    assert [r["lang_pred"] for r in langid.predict_language(make([(1, SENTENCE)]), none).collect()] == ["und"]


def test_sample_is_bounded(spark, make):
    docs = make([(i, f"text {i}", "en") for i in range(500)])
    texts, labels = langid.training_sample(docs, per_label=20)
    assert len(texts) == len(labels) <= 20


def test_whole_texts_are_trained_on(spark, make):
    """Texts whose first 4,200 letters are the same in all languages."""
    rng = random.Random(2)
    same = "xyzzy " * 700
    train = make([(i, same + _text(rng, k, 3000), k) for i, k in enumerate(list(PARTS) * 40)])
    model = langid.fit_language_model(train)
    got = langid.predict_language(make([(i, same + _text(rng, k, 3000), k) for i, k in enumerate(list(PARTS) * 20)]), model).collect()
    assert sum(r["lang_pred"] == r["lang"] for r in got) >= 0.98 * len(got)


def test_too_many_labels_are_an_error(make, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LABELS", 2)
    with pytest.raises(ValueError, match="3 labels"):
        langid.training_sample(make([(i, f"text {i}", k) for i, k in enumerate(PARTS)]))


def test_marks_are_no_letters_and_clashing_columns(make):
    model = langid.fit_language_model(make([(i, f"the thing {i}", "en") for i in range(30)]))
    rows = langid.predict_language(make([(1, "² ½ ①"), (2, "the thing")]).withColumnRenamed("extra", "lang_pred"), model)
    assert rows.columns.count("lang_pred") == 1
    assert {r["doc_id"]: r["lang_pred"] for r in rows.collect()} == {1: "und", 2: "en"}
    assert langid._normal("Tree—house²x") == b" tree house x "
