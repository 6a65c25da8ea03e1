"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Method: texts and test items are words of letters and digits in lower case (A-Z). Every n-gram of an item is a
seed: of an edited copy the n-gram that is left may be a common one, so a choice of the rarest would lose it.
Documents that hold a seed are aligned with the item around the place (local alignment of words: match 2,
mismatch and gap -1); the score is the share of the item's perfect score, and ``min_score`` or more is a leak. A
place with too few words of the item to reach ``min_score`` is not aligned.

Guarantee: a place that reaches ``min_score`` and shares ``SEED_WORDS`` words in a row with the item is found,
wherever its edits lie. A place without such a run (an edit in every four words can leave 0.625) is not.

Scale: items of together at most ``BROADCAST_WORDS`` words (counted first) are broadcast, and documents are
read once without a shuffle. More items are joined instead: items become rows of seeds, texts rows of n-grams
with their places, an equi-join on the n-gram (skewed partitions are split by AQE) gives places, and pairs of
document and item are dealt over all tasks for alignment. Both give the same leaks.

Defined results: null or empty texts and items match nothing; items of fewer words than a seed are sought
as a whole; long texts are scanned whole; an item's best place in a document is reported, the first one of
equals; items that repeat are reported each; a document's leaks are sorted by the item's id as text; repeated rows,
null ids and empty tables need no care; extra columns stay, but one named like the result is replaced.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ngrams, settle, slices, small_batches, texts, with_fields, word_hashes, word_spans
from .lm_score import Lookup

SEED_WORDS = 4
MIN_SCORE = 0.5
BROADCAST_WORDS = 1_000_000
_SLICE = 1 << 20
_FOLD = np.array([c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], np.uint8)


def hashed_words(batch: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in a row, and where each text's words begin (one more entry than texts)."""
    buf = _FOLD[np.frombuffer(b" ".join([*batch, b""]), np.uint8)]
    start, end = word_spans(buf)
    first = np.cumsum([0, *(len(t) + 1 for t in batch)])
    return word_hashes(buf, start, end), np.searchsorted(start, first)


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment score (match 2, mismatch -1, gap -1), and its start and end in the passage.

    Row by row; the gap along a row is a running maximum of scores plus their position, and every score carries
    the place where its alignment starts."""
    width = len(passage)
    steps = np.arange(width + 1)
    prev, starts, best = np.zeros(width + 1, np.int64), steps, (0, 0, 0)
    for w in item:
        row, begin = np.zeros(width + 1, np.int64), steps.copy()
        across, down = prev[:-1] + np.where(passage == w, 2, -1), prev[1:] - 1
        row[1:] = np.maximum(across, down)
        begin[1:] = np.where(across >= down, np.where(prev[:-1] > 0, starts[:-1], steps[:-1]), starts[1:])
        none = row <= 0
        row[none], begin[none] = 0, steps[none]
        run = np.maximum.accumulate((row + steps) * (width + 1) + width - steps)
        row, begin = run // (width + 1) - steps, begin[width - run % (width + 1)]
        top = int(row.argmax())
        if row[top] > best[0]:
            best = int(row[top]), int(begin[top]), top
        prev, starts = row, begin
    return best


def best_place(w: np.ndarray, h: np.ndarray, low: int, high: int, begins: list[int], min_score: float) -> tuple[float, int, int] | None:
    """Align the item ``w`` with the words ``h[low:high]`` of a text around its seeds, each as far to both sides as gaps
    can move a place that reaches ``min_score``: share of the perfect score, first word, end word. Surroundings with
    fewer words of the item than that takes are left out."""
    m, best, begins = len(w), None, sorted(begins)
    reach, own = int(2 * m * max(0.0, 1 - min_score)) + 1, np.unique(w)
    k = 0
    while k < len(begins):
        a = b = begins[k]
        while k < len(begins) and begins[k] <= b + m and begins[k] - a < 8 * m + 64:
            b = begins[k]
            k += 1
        a, b = max(low, a - reach), min(high, b + m + reach)
        passage = h[a:b]
        at = np.minimum(np.searchsorted(own, passage), len(own) - 1)
        if np.count_nonzero(own[at] == passage) < min_score * m:
            continue
        score, start, end = align(w, passage)
        share = score / (2 * m)
        if best is None or share > best[0]:
            best = share, a + start - low, a + end - low
        if share == 1.0:
            break
    return best


def item_words(items: list[bytes]) -> list[np.ndarray]:
    h, first = hashed_words(items)
    return [h[a:b] for a, b in zip(first, first[1:], strict=False)]


class ItemBlock:
    """Items with their word hashes and seeds."""

    def __init__(self, ids: list, items: list[bytes]) -> None:
        self.ids, self.words = ids, item_words(items)
        owners: dict[int, dict[int, list]] = defaultdict(lambda: defaultdict(list))
        for i, w in enumerate(self.words):
            n = min(SEED_WORDS, len(w))
            for at, g in enumerate(ngrams(w, n).tolist() if n else ()):
                owners[n][g].append((i, at))
        self.owners = {n: dict(v) for n, v in owners.items()}
        self.lookups = {n: Lookup(np.array(sorted(v), np.uint64), np.zeros(len(v))) for n, v in owners.items()}

    def matches(self, batch: list[bytes], min_score: float) -> list[list[tuple[int, float, int, int]]]:
        """Per text: (item number, score, first word, end word) of each item that reaches ``min_score``."""
        out: list[list] = [[] for _ in batch]
        for i, j in slices([len(t) for t in batch], _SLICE):
            h, first = hashed_words(batch[i:j])
            hits: dict[tuple[int, int], list[int]] = defaultdict(list)
            for n, lookup in self.lookups.items():
                keys = ngrams(h, n)
                at = np.flatnonzero(lookup.find(keys) >= 0)
                doc = np.searchsorted(first, at, "right") - 1
                inside = at + n <= first[doc + 1]
                for p, d in zip(at[inside].tolist(), doc[inside].tolist(), strict=True):
                    for item, offset in self.owners[n][int(keys[p])]:
                        hits[d, item].append(p - offset)
            for (d, item), begins in hits.items():
                best = best_place(self.words[item], h, int(first[d]), int(first[d + 1]), begins, min_score)
                if best and best[0] >= min_score:
                    out[i + d].append((item, *best))
        for m in out:
            m.sort()
        return out


def _broadcast_leaks(docs: DataFrame, rows: list, struct: str, text_col: str, min_score: float, out_col: str) -> DataFrame:
    rows = sorted(rows, key=lambda r: (str(r["id"]), r["text"]))
    docs = small_batches(docs)
    sent = docs.sparkSession.sparkContext.broadcast(ItemBlock([r["id"] for r in rows], [r["text"].encode("utf-8", "replace") for r in rows]))

    @F.pandas_udf(f"struct<leaks: {struct}>")
    def match(column: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        block = sent.value
        for s in column:
            found = block.matches([(x or "").encode("utf-8", "replace") for x in s], min_score)
            yield pd.DataFrame({"leaks": pd.Series([[{"item_id": block.ids[i], "score": v, "first_word": a, "end_word": b} for i, v, a, b in m] for m in found], dtype=object)})

    return with_fields(docs, match(F.col(text_col)), {out_col: "leaks"})


def _joined_leaks(docs: DataFrame, items: DataFrame, struct: str, text_col: str, min_score: float, out_col: str) -> DataFrame:
    """Leaks by an equi-join of texts' n-grams with items' seeds. Equal texts are one; a text is known by two 64-bit
    hashes, an item by those of its text."""
    key = lambda c: (F.xxhash64(F.lit(0), c), F.xxhash64(F.lit(1), c))
    docs = small_batches(docs)
    ids = settle(items.groupBy("id", "text").agg(F.count("*").alias("n")).withColumns(dict(zip(("i1", "i2"), key(F.col("text")), strict=True))))
    whole = ids.select("i1", "i2", F.col("text").alias("item")).dropDuplicates(["i1", "i2"])

    def grams_of(k1: str, k2: str, text: str, least: bool):
        """Rows (n, gram, k1, k2, place) of the n-grams of each text; of items (``least``) of one length only."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cols = {c: b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in (k1, k2)}
                for i, t in enumerate(texts(b, text)):
                    h = item_words([t])[0]
                    for n in (min(SEED_WORDS, len(h)),) if least else range(1, SEED_WORDS + 1):
                        if n and len(g := ngrams(h, n)):
                            same = lambda v, g=g: pa.array(np.full(len(g), v, np.int64))
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), n, np.int32)), pa.array(g.view(np.int64)), same(cols[k1][i]), same(cols[k2][i]), pa.array(np.arange(len(g)))], ["n", "gram", k1, k2, "place"])

        return run

    schema = "n int, gram bigint, {} bigint, {} bigint, place bigint"
    seeds = settle(whole.mapInArrow(grams_of("i1", "i2", "item", True), schema.format("i1", "i2")).withColumnRenamed("place", "offset"))
    used = [r["n"] for r in seeds.select("n").distinct().collect()]
    keyed = docs.where(F.col(text_col).isNotNull()).select(*(c.alias(k) for k, c in zip(("k1", "k2"), key(F.col(text_col)), strict=True)), F.col(text_col).alias("body"))
    grams = keyed.mapInArrow(grams_of("k1", "k2", "body", False), schema.format("k1", "k2")).where(F.col("n").isin(used))
    hits = grams.join(seeds, ["n", "gram"]).groupBy("k1", "k2", "i1", "i2").agg(F.collect_set(F.col("place") - F.col("offset")).alias("begins"))
    hits = settle(hits)
    bodies = keyed.join(hits.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
    pairs = hits.join(bodies, ["k1", "k2"]).join(whole, ["i1", "i2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            begins = b.column(b.schema.get_field_index("begins")).to_pylist()
            best = []
            for body, item, at in zip(texts(b, "body"), texts(b, "item"), begins, strict=True):
                h = item_words([body])[0]
                found = best_place(item_words([item])[0], h, 0, len(h), at, min_score)
                best.append(found if found and found[0] >= min_score else (None, None, None))
            keys = [b.column(b.schema.get_field_index(c)) for c in ("k1", "k2", "i1", "i2")]
            values = [pa.array([x[k] for x in best], t) for k, t in enumerate((pa.float64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*keys, *values], ["k1", "k2", "i1", "i2", "score", "first_word", "end_word"])

    aligned = pairs.select("k1", "k2", "i1", "i2", "begins", "body", "item").mapInArrow(run, "k1 bigint, k2 bigint, i1 bigint, i2 bigint, score double, first_word bigint, end_word bigint").where("score is not null")
    named = aligned.join(ids, ["i1", "i2"]).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))))
    leak = F.struct(F.col("id").cast("string").alias("o1"), F.col("text").alias("o2"), "copy", F.struct(F.col("id").alias("item_id"), "score", "first_word", "end_word").alias("leak"))
    found = named.groupBy("k1", "k2").agg(F.transform(F.array_sort(F.collect_list(leak)), lambda x: x["leak"]).alias("leaks"))
    own = {f"o{i}": c for i, c in enumerate(docs.columns) if c != out_col}
    k1, k2 = key(F.col(text_col))
    rows = docs.select(*(F.col(f"`{c}`").alias(o) for o, c in own.items()), k1.alias("d1"), k2.alias("d2"), F.col(text_col).isNull().alias("null_text"))
    rows = rows.join(found, ~F.col("null_text") & (F.col("d1") == F.col("k1")) & (F.col("d2") == F.col("k2")), "left")
    return rows.select(*(F.col(o).alias(c) for o, c in own.items()), F.coalesce("leaks", F.expr(f"cast(array() as {struct})")).alias(out_col))


def find_leaks(docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", min_score: float = MIN_SCORE, broadcast_words: int = BROADCAST_WORDS, out_col: str = "leaks") -> DataFrame:
    """``docs`` with ``out_col``: array of (item_id, score, first_word, end_word), empty for clean rows."""
    kind = items.schema[item_id_col].dataType.simpleString()
    struct = f"array<struct<item_id: {kind}, score: double, first_word: bigint, end_word: bigint>>"
    rows = items.where(F.col(item_text_col).isNotNull()).select(F.col(item_id_col).alias("id"), F.col(item_text_col).alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.regexp_count(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+"))), F.lit(0)).alias("n")).first()["n"]
    if total <= broadcast_words:
        return _broadcast_leaks(docs, rows.collect(), struct, text_col, min_score, out_col)
    return _joined_leaks(docs, rows, struct, text_col, min_score, out_col)
