import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField(n, T.LongType() if n in ("doc_id", "n_chars") else T.StringType()) for n in ("doc_id", "text", "lang", "source", "n_chars", "component_id", "extra")])
SENTENCE = "the quick brown fox jumps over the lazy dog and runs into the dark green forest near a river"


@pytest.fixture
def make(spark):
    """Documents with extra columns of clashing names, from (doc_id, text) or longer tuples."""

    def build(rows):
        full = [(*r, *[None] * (4 - len(r)))[:4] for r in rows]
        return spark.createDataFrame([(i, t, lang, src, None if t is None else len(t), "clash", None) for i, t, lang, src in full], SCHEMA)

    return build


@pytest.fixture
def odd_rows():
    """Null id, null text, empty text, repeated rows, a tie, a very long text."""
    long = " ".join(f"word{i % 977} {SENTENCE}" for i in range(3000))
    return [(1, SENTENCE, "en", "a"), (1, SENTENCE, "en", "a"), (None, SENTENCE, None, None), (2, None, "en", "a"), (3, "", None, "b"), (4, " \n\t ", "de", None), (5, long, "en", "b"), (6, "Ünïcödé \U0001f600 x", "de", "c")]
