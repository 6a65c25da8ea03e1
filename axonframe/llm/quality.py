"""Quality rules: a table of thresholds compiled into one projection of native expressions.

Method: every metric is a Spark expression over the whole text, whose words and lines are cut once; every rule of
``RULES`` becomes one comparison of a metric with bounds; all of them stand in a single projection without
shuffles, joins or user functions.

Defined results: a null or empty text has no words and fails the length rule; very long texts are judged
whole; rows are independent, so ties, repeated rows, empty tables and null ids need no care; extra columns
are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, WORD, let, words

# Frequent function words of the four languages of the corpus.
STOP_WORDS = {
    "en": ["the", "be", "to", "of", "and", "that", "have", "with", "a", "in", "is", "it", "for", "on", "this", "are", "was", "or", "as", "by"],
    "de": ["der", "die", "das", "und", "ist", "nicht", "mit", "von", "den", "zu", "ein", "eine", "im", "auf", "sich", "dem", "des", "für", "als", "auch"],
    "fr": ["le", "la", "les", "de", "des", "et", "un", "une", "du", "en", "est", "que", "qui", "dans", "pour", "pas", "sur", "au", "par", "avec"],
    "es": ["el", "la", "los", "las", "de", "que", "y", "en", "un", "una", "es", "se", "por", "con", "para", "del", "no", "su", "al", "lo"],
}


@dataclass(frozen=True)
class Rule:
    """Pass if ``low <= metric <= high``; a missing bound is open. ``metric`` names an entry of ``metrics``."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None


RULES = (
    Rule("word_count", "n_words", low=50),
    Rule("mean_word_length", "mean_word_length", low=2.0, high=15.0),
    Rule("symbols_per_word", "symbol_ratio", high=0.1),
    Rule("stop_words", "stop_word_ratio", low=0.02),
    Rule("upper_case", "upper_ratio", high=0.5),
    Rule("bare_marks", "mark_word_ratio", high=0.2),
    Rule("ellipsis_lines", "ellipsis_line_ratio", high=0.3),
    Rule("bullet_lines", "bullet_line_ratio", high=0.9),
    Rule("repeated_lines", "dup_line_ratio", high=0.6),
    Rule("repeated_words", "repeat_word_ratio", high=0.5),
)


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def repeat_words(w: Column) -> Column:
    """Number of words inside 3-word windows that occur twice or more among the words ``w``.

    Each window becomes one long, the top 40 bits of its hash above its position. In sorted order equal windows are
    neighbours. The words of neighbours with equal bits are compared: were two of them different, the row is counted
    by the windows themselves (``_repeat_words_by_text``), so the number is exact. The positions of repeated windows
    are sorted again, and each covers the words up to the next one, three at most."""

    def count(w: Column) -> Column:
        n = F.size(w)
        low, high = F.lit((1 << 24) - 1).cast("bigint"), F.lit(-1 << 24).cast("bigint")
        packed = F.transform(
            F.sequence(F.lit(0), n - 3),
            lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(high).bitwiseOR(i.cast("bigint")),
        )

        def at(v: Column) -> Column:
            return v.bitwiseAND(low).cast("int")

        def same(a: Column, b: Column) -> Column:
            return (F.get(w, at(a)) == F.get(w, at(b))) & (F.get(w, at(a) + 1) == F.get(w, at(b) + 1)) & (F.get(w, at(a) + 2) == F.get(w, at(b) + 2))

        def near(s: Column, k: Column, v: Column) -> Column:
            return F.coalesce(F.get(s, k).bitwiseXOR(v).bitwiseAND(high) == 0, F.lit(False))

        def covered(s: Column) -> Column:
            again = F.filter(s, lambda v, k: near(s, k - 1, v) | near(s, k + 1, v))

            def exact(a: Column) -> Column:
                differ = F.exists(F.zip_with(a, F.slice(a, 2, F.greatest(F.size(a), F.lit(1))), lambda x, y: near(F.array(x), F.lit(0), y) & ~same(x, y)), lambda x: F.coalesce(x, F.lit(False)))
                return F.when(F.size(a) == 0, F.lit(0)).when(differ, _repeat_words_by_text(w)).otherwise(_cover(F.transform(a, at)))

            return let(again, exact)

        return F.when(n < 4, F.lit(0)).when(n >= 1 << 24, _repeat_words_by_text(w)).otherwise(let(F.sort_array(packed), covered))

    return let(w, count).cast("long")


def _cover(at: Column) -> Column:
    """Number of words that windows of three at the positions ``at`` cover."""
    return let(
        F.sort_array(at),
        lambda p: F.aggregate(
            F.zip_with(p, F.slice(p, 2, F.greatest(F.size(p), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3))),
            F.lit(0),
            lambda t, x: t + x,
        ),
    )


def _repeat_words_by_text(w: Column) -> Column:
    """The same from the windows' texts, sorted with their positions."""
    windows = F.transform(
        F.sequence(F.lit(0), F.size(w) - 3),
        lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("x"), i.alias("i")),
    )

    def covered(s: Column) -> Column:
        same = lambda v, k: F.coalesce(F.get(s, k)["x"] == v["x"], F.lit(False))
        return _cover(F.transform(F.filter(s, lambda v, k: same(v, k - 1) | same(v, k + 1)), lambda v: v["i"]))

    return let(F.sort_array(windows), covered)


def metrics(text: Column) -> Column:
    """A struct of the named metrics of ``text``; its words and lines are cut once and shared."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    stops = sorted({x for v in STOP_WORDS.values() for x in v})

    def counts(cut: Column) -> Column:
        w, lines, t = cut["w"], cut["l"], cut["t"]
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(_without(t, SPACES)).cast("long").alias("word_chars"),
            (F.length(t) - F.length(_without(t, "#*$%&|<>"))).cast("long").alias("n_symbols"),
            F.size(lines).alias("lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            repeat_words(w).alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(stops))).alias("stops"),
            F.length(F.regexp_replace(t, r"\P{Lu}+", "")).alias("uppers"),
            F.length(F.regexp_replace(t, r"\P{Ll}+", "")).alias("lowers"),
            F.size(F.filter(w, lambda x: ~x.rlike(r"[\p{L}\p{N}]"))).alias("marks"),
            F.size(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))).alias("ellipses"),
            F.size(F.filter(lines, lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•·][\x20\x09-\x0D]"))).alias("bullets"),
        )

    return let(F.struct(t.alias("t"), words(t).alias("w"), lines.alias("l")), counts)


def ratios() -> dict[str, Column]:
    c = F.col
    return {
        "mean_word_length": _ratio(c("word_chars"), c("n_words")),
        "symbol_ratio": _ratio(c("n_symbols"), c("n_words")),
        "stop_word_ratio": _ratio(c("stops"), c("n_words")),
        "upper_ratio": _ratio(c("uppers"), c("uppers") + c("lowers")),
        "mark_word_ratio": _ratio(c("marks"), c("n_words")),
        "ellipsis_line_ratio": _ratio(c("ellipses"), c("lines")),
        "bullet_line_ratio": _ratio(c("bullets"), c("lines")),
        "dup_line_ratio": _ratio(c("n_dup_lines"), c("lines")),
        "repeat_word_ratio": _ratio(c("n_repeat_words"), c("n_words")),
    }


def compile_rules(rules: tuple[Rule, ...]) -> Column:
    """The names of the rules a row fails, as an array; the row is good if it is empty."""
    failed = []
    for r in rules:
        ok = F.lit(True)
        if r.low is not None:
            ok = ok & (F.col(r.metric) >= r.low)
        if r.high is not None:
            ok = ok & (F.col(r.metric) <= r.high)
        failed.append(F.when(~ok, F.lit(r.name)))
    return F.filter(F.array(*failed), lambda x: x.isNotNull())


def quality_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of ``docs``: its id, every metric, ``failed`` (names of failed rules) and ``good``."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.inline(F.array(metrics(F.col(text_col)))))
    full = base.select("*", *(v.alias(k) for k, v in ratios().items()))
    return full.withColumn("failed", compile_rules(rules)).withColumn("good", F.size("failed") == 0)
