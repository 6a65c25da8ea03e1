"""Document fingerprints by consistent weighted sampling.

Method: a document is its words (A-Z lower-cased), weighted by their counts. For each of ``SAMPLES`` samples a word
draws r and c from a gamma distribution of shape 2 and b uniformly, all from hashes of word and sample alone; with
t = floor(ln(weight) / r + b) the sample is the (word, t) of the least ln(c) - r (t - b + 1). Two documents draw the same
sample with odds of their generalised Jaccard similarity (sum of the lesser counts over sum of the greater), so the share
of equal samples estimates it with a standard error of at most 0.5 / sqrt(SAMPLES). A sample is kept as 16 bits. r, b and c are quantiles
that parts of one 64-bit hash choose (2**16, 2**16 and 2**18 of them).

The edited text of a document needs the next document in order of ids: texts are moved once, by a range sort, and a task passes over
its sorted rows; the last row of a partition meets the first one of the next partition in a second, small step with
one row per partition.

Defined results: null text is empty; texts without words have the fingerprint of zeros and are like one another (1) and
unlike others (0); null ids stand last, rows that agree in id are in order of a hash of their texts; equal rows are documents
of their own; the next document of a lone row is itself; columns other than id and text are not read; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import LOWER, UPPER, mix64, settle

#: Samples of a fingerprint, words (with their counts) whose draws a task remembers, words that are compared at once,
#: and words that are drawn at once.
SAMPLES = 128
CACHE_WORDS = 163_840
CHUNK_WORDS = 8_192
DRAW_WORDS = 128
#: Rows of a batch whose texts are decoded together.
SLICE_ROWS = 256
#: Bits of the quantiles of r, of c and of b, all taken from one hash.
R_BITS, C_BITS, B_BITS = 16, 18, 16

_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
_LANES = mix64(np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def gamma_quantiles(bits: int) -> np.ndarray:
    """The mid quantiles of 2**bits equal parts of the gamma distribution of shape 2 and scale 1, by bisection."""
    want = (np.arange(1 << bits) + 0.5) / (1 << bits)
    low, high = np.zeros(1 << bits), np.full(1 << bits, 64.0)
    for _ in range(50):
        mid = (low + high) / 2
        under = 1 - (1 + mid) * np.exp(-mid) < want
        low, high = np.where(under, mid, low), np.where(under, high, mid)
    return (low + high) / 2


class Sampler:
    """Fingerprints of texts; remembers the draws of up to ``CACHE_WORDS`` words with their counts."""

    def __init__(self) -> None:
        self.r = gamma_quantiles(R_BITS).astype(np.float32)
        # 1 - b of every quantile of b
        self.rest = (1 - (np.arange(1 << B_BITS) + 0.5) / (1 << B_BITS)).astype(np.float32)
        self.log_c = np.log(gamma_quantiles(C_BITS)).astype(np.float32)
        self.seen: dict[tuple[bytes, int], int] = {}
        self.values = np.empty((CACHE_WORDS, SAMPLES), np.float32)
        self.hashes = np.empty(CACHE_WORDS, np.uint64)

    def _draw(self, h: np.ndarray, lanes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """r, 1 - b and log c for words by lanes (shapes broadcast)."""
        with np.errstate(over="ignore"):
            x = h ^ lanes
            x *= np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(32)
            x *= np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(29)
        x = x.view(np.int64)
        r = self.r.take(x & ((1 << R_BITS) - 1))
        x >>= R_BITS
        rest = self.rest.take(x & ((1 << B_BITS) - 1))
        x >>= B_BITS
        x &= (1 << C_BITS) - 1
        return r, rest, self.log_c.take(x)

    def _rows(self, items: list[tuple[bytes, int]]) -> np.ndarray:
        """Indices of the draws of at most ``CHUNK_WORDS`` words."""
        known = list(map(self.seen.get, items))
        new = [x for x, k in zip(items, known, strict=True) if k is None] if None in known else []
        if len(self.seen) + len(new) > CACHE_WORDS:
            self.seen.clear()
            new = items
        if new:
            at = len(self.seen)
            h = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w, _ in new), np.uint64, len(new))
            log_n = np.log(np.fromiter((n for _, n in new), np.float32, len(new)))
            for i in range(0, len(new), DRAW_WORDS):
                r, rest, value = self._draw(h[i : i + DRAW_WORDS, None], _LANES)
                many = np.flatnonzero(log_n[i : i + DRAW_WORDS])
                if len(many):  # t is 0 at a count of one
                    rest[many] += np.floor(log_n[i + many, None] / r[many] + np.float32(1) - rest[many])
                rest *= r
                value -= rest
                self.values[at + i : at + i + len(value)] = value
            self.hashes[at : at + len(new)] = h
            self.seen.update(zip(new, range(at, at + len(new)), strict=True))
            known = map(self.seen.__getitem__, items)
        return np.fromiter(known, np.int64, len(items))

    def fingerprint(self, text: bytes) -> np.ndarray:
        """``SAMPLES`` numbers of 16 bits."""
        items = list(Counter(text.translate(_FOLD).split()).items())
        if not items:
            return np.zeros(SAMPLES, np.uint16)
        least = np.full(SAMPLES, np.inf, np.float32)
        h, log_n = np.zeros(SAMPLES, np.uint64), np.zeros(SAMPLES, np.float32)
        for i in range(0, len(items), CHUNK_WORDS):
            rows = self._rows(items[i : i + CHUNK_WORDS])
            values = self.values.take(rows, axis=0)
            best = values.argmin(axis=0)  # of equal ones the first
            lower = values[best, np.arange(SAMPLES)]
            won = lower < least
            least = np.minimum(least, lower)
            h[won] = self.hashes[rows[best[won]]]
            log_n[won] = np.log(np.fromiter((items[i + k][1] for k in best[won]), np.float32, int(won.sum())))
        r, rest, _ = self._draw(h, _LANES)
        t = np.floor(log_n / r + np.float32(1) - rest)
        with np.errstate(over="ignore"):
            mixed = mix64(mix64(h ^ _LANES) + t.astype(np.int64).astype(np.uint64))
        return (mixed >> np.uint64(48)).astype(np.uint16)


@functools.cache
def worker_sampler() -> Sampler:
    """The sampler of this Python process; tasks that follow one another find the words of the last one."""
    return Sampler()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated generalised Jaccard similarity: the share of equal samples."""
    return float(np.count_nonzero(a == b)) / SAMPLES


def edit(text: str, following: str) -> str:
    """``text`` with its last half replaced by as many code points of the start of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


RESULT = "n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def _result(sampler: Sampler, text: str, print_: np.ndarray, following: str, next_print: np.ndarray) -> tuple:
    changed = edit(text, following).encode()
    other = sampler.fingerprint(changed)
    return (len(text), hashlib.sha256(changed).hexdigest(), print_.tobytes(), other.tobytes(), likeness(print_, other), likeness(print_, next_print))


def _rows(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    for batch in batches:
        for i in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(i, SLICE_ROWS)
            yield from zip(*(part.column(part.schema.get_field_index(c)).to_pylist() for c in columns), strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == SLICE_ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def fingerprint_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id, n_chars, edited_sha256, ``fingerprint`` and ``edited_fingerprint`` (binary), near_edited
    and near_next."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("tie")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text", F.spark_partition_id().alias("part"))
    kind = dict(dealt.dtypes)["doc_id"]
    # kind 0: a result; 1 and 2: the last and the first document of a partition, with the text.
    schema = to_arrow_schema(StructType.fromDDL(f"kind int, part int, doc_id {kind}, text string, {RESULT}"))
    none = (None,) * 6

    def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def results() -> Iterator[tuple]:
            sampler, last = worker_sampler(), None
            for i, text, part in _rows(batches, "doc_id", "text", "part"):
                own = sampler.fingerprint(text.encode())
                if last is None:
                    yield (2, part, i, text, *none)
                else:
                    yield (0, part, last[0], None, *_result(sampler, last[1], last[2], text, own))
                last = (i, text, own, part)
            if last is not None:
                yield (1, last[3], last[0], last[1], *none)

        return _batches(results(), schema)

    done = settle(dealt.mapInArrow(along, f"kind int, part int, doc_id {kind}, text string, {RESULT}"))
    heads = done.where("kind = 2").select(F.col("part").alias("next"), F.col("text").alias("following"))
    parts = done.where("kind = 1").select("part")  # one row per partition
    turn = parts.select("part", F.coalesce(F.lead("part").over(W.orderBy("part")), F.min("part").over(W.partitionBy())).alias("next"))
    open_ = done.where("kind = 1").select("part", "doc_id", "text").join(turn, "part").join(heads, "next").select("doc_id", "text", "following")
    out = to_arrow_schema(StructType.fromDDL(f"doc_id {kind}, {RESULT}"))

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def results() -> Iterator[tuple]:
            sampler = worker_sampler()
            for i, text, following in _rows(batches, "doc_id", "text", "following"):
                yield (i, *_result(sampler, text, sampler.fingerprint(text.encode()), following, sampler.fingerprint(following.encode())))

        return _batches(results(), out)

    names = ["doc_id", *(f.split()[0] for f in RESULT.split(", "))]
    whole = done.where("kind = 0").select(*names).unionByName(open_.mapInArrow(across, f"doc_id {kind}, {RESULT}"))
    return whole.withColumnRenamed("doc_id", id_col)
