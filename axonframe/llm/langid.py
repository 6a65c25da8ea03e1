"""Language ID: averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy.

Method: a text is lower-cased, everything but letters and their marks becomes a gap, and the byte n-grams of its words (with
a gap at each end) are hashed into ``BUCKETS`` rows of an embedding table. The mean of a text's rows goes
through a linear softmax. Both layers are trained by stochastic gradient descent on a bounded sample of
labelled rows (``TRAIN_PER_LABEL`` rows a label, chosen by a hash of the id), of which whole texts count: the
executors reduce each to its bucket counts. On rows of the sample that are not
trained on, a temperature is fitted to the scores and a rejection threshold is set such that of correct
predictions about ``FALSE_REJECT`` or less fall below.

For prediction the two layers fold into one table (bucket x label), which is constant in size.

Defined results: a null text or one without a letter is ``und`` with score 0 and rejected; whole texts count;
ties go to the first label in sorted order; rows without a label are not trained on; with no labelled rows
everything is ``und``; more than ``MAX_LABELS`` labels are an error; repeated rows, null ids, empty tables and extra columns need no care.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle, small_batches, texts, with_fields

#: Parameters of the model and of its bounded training sample.
BUCKETS = 1 << 15
DIM = 16
ORDERS = (2, 3, 4)
TRAIN_PER_LABEL = 1500
MAX_LABELS = 500
EPOCHS = 4
FALSE_REJECT = 0.001

LETTER = regex.compile(r"\p{L}")
#: Letters and the marks that combine with them; everything else is a gap.
GAPS = regex.compile(r"[^\p{L}\p{M}]+")
_CHUNK = 1 << 20


def _normal(text: str) -> bytes:
    return GAPS.sub(" ", f" {text.lower()} ").encode("utf-8", "replace")


def _ids(buf: np.ndarray, order: int) -> np.ndarray:
    """Bucket of the n-gram that starts at each byte, -1 where it spans a gap or is one."""
    n = len(buf) - order + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    h = np.full(n, order, np.uint32)
    inner = np.zeros(n, bool)
    empty = np.ones(n, bool)
    for j in range(order):
        b = buf[j : j + n]
        h = (h ^ b) * np.uint32(16777619)
        gap = b == 32
        if 0 < j < order - 1:
            inner |= gap
        empty &= gap
    if order > 1:
        inner |= (buf[:n] == 32) & (buf[order - 1 : order - 1 + n] == 32) & (order == 2)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(12)
    out = (h & np.uint32(BUCKETS - 1)).astype(np.int64)
    out[inner | empty] = -1
    return out


def features(text: str) -> bytes:
    """The distinct buckets of all n-grams of a text and their counts, packed (at most ``BUCKETS`` of them)."""
    buf, times = np.frombuffer(_normal(text), np.uint8), np.zeros(BUCKETS, np.int64)
    for k in ORDERS:
        for at in range(0, max(1, len(buf) - k + 1), _CHUNK):
            ids = _ids(buf[at : at + _CHUNK + k - 1], k)
            times += np.bincount(ids[ids >= 0], minlength=BUCKETS)
    at = np.flatnonzero(times)
    return zlib.compress(np.diff(at, prepend=0).astype("<u2").tobytes() + times[at].astype("<u4").tobytes(), 1)


def _shares(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets and their shares of a text."""
    raw = zlib.decompress(packed)
    n = len(raw) // 6
    at, times = np.cumsum(np.frombuffer(raw, "<u2", n)).astype(np.int32), np.frombuffer(raw, "<u4", n, 2 * n).astype(np.int64)
    return at, (times / max(1, times.sum())).astype(np.float32)


@dataclass
class LangModel:
    labels: list[str]
    table: np.ndarray  # bucket x label, float32
    bias: np.ndarray
    temperature: float
    threshold: float

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Label index (-1: none) and calibrated probability of each text."""
        if not self.labels:
            return np.full(len(texts), -1), np.zeros(len(texts))
        logits = np.zeros((len(texts), len(self.labels)))
        known = np.zeros(len(texts), bool)
        for i, t in enumerate(texts):
            if not t or not LETTER.search(t):
                continue
            known[i] = True
            buf, total, count = np.frombuffer(_normal(t), np.uint8), np.zeros(len(self.labels)), 0
            for k in ORDERS:
                for at in range(0, max(1, len(buf) - k + 1), _CHUNK):
                    ids = _ids(buf[at : at + _CHUNK + k - 1], k)
                    hist = np.bincount(ids[ids >= 0], minlength=BUCKETS) if len(ids) > BUCKETS else None
                    if hist is not None:
                        total += hist @ self.table
                        count += int(hist.sum())
                    else:
                        ids = ids[ids >= 0]
                        total += self.table[ids].sum(axis=0, dtype=np.float64)
                        count += len(ids)
            logits[i] = total / max(1, count) + self.bias
        z = logits / self.temperature
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        return np.where(known, best, -1), np.where(known, p[np.arange(len(texts)), best], 0.0)


def train(packed: list[bytes], labels: list[str], *, seed: int = 7, epochs: int = EPOCHS, false_reject: float = FALSE_REJECT) -> LangModel:
    """Fit the model to the ``features`` of texts; a fifth of the rows is kept from the training for calibration."""
    names = sorted(set(labels))
    if not names:
        return LangModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    xs, ys = [_shares(t) for t in packed], np.array([names.index(x) for x in labels])
    emb = rng.normal(0, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, len(names)), np.float32), np.zeros(len(names), np.float32)
    order = [i for i in rng.permutation(len(xs)) if len(xs[i][0])]
    held, fit = order[: len(order) // 5], order[len(order) // 5 :]
    for epoch in range(epochs):
        for step, i in enumerate(rng.permutation(fit)):
            rate = np.float32(0.5 * (1 - (epoch + step / max(1, len(fit))) / epochs))
            uniq, share = xs[i][0], xs[i][1][:, None]
            mean = (emb[uniq] * share).sum(axis=0)
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[ys[i]] -= 1
            back = out @ p
            out -= rate * np.outer(mean, p)
            bias -= rate * np.float32(0.1) * p
            emb[uniq] -= rate * len(uniq) ** np.float32(0.5) * share * back
    model = LangModel(names, (emb @ out).astype(np.float32), bias.astype(np.float64), 1.0, 0.0)
    if held:
        logits = np.array([xs[i][1].astype(np.float64) @ model.table[xs[i][0]] + model.bias for i in held])
        y = ys[held]

        def loss(t: float) -> float:
            z = logits / t
            z = z - z.max(axis=1, keepdims=True)
            return float(-(z[np.arange(len(y)), y] - np.log(np.exp(z).sum(axis=1))).mean())

        model.temperature = min((float(t) for t in np.geomspace(0.05, 5, 60)), key=loss)
        z = logits / model.temperature
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        right = p[np.arange(len(y)), p.argmax(axis=1)][p.argmax(axis=1) == y]
        if len(right):
            model.threshold = float(min(0.5, np.quantile(right, false_reject)))
    return model


def training_sample(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_label: int = TRAIN_PER_LABEL) -> tuple[list[bytes], list[str]]:
    """The ``features`` and labels of at most ``per_label`` rows a label, each the first of its hash slot.

    A label's rows are dealt into ``per_label`` slots by a hash of the id, and each slot keeps its smallest:
    an aggregation of hashes with partial results, so a frequent label meets in no task. The rows found go through
    ``features`` where they are read, and only those are collected."""
    docs = small_batches(docs)
    key = F.xxhash64(F.lit("lang"), F.col(id_col).cast("string"))
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("l"), key.alias("k"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("t"))
    slots = rows.groupBy("l", F.pmod("k", F.lit(per_label)).alias("slot")).agg(F.min(F.struct("k", "h")).alias("x"))
    chosen = settle(slots.select("l", "x.k", "x.h"))
    if (n := chosen.select("l").distinct().count()) > MAX_LABELS:
        raise ValueError(f"{n} labels are more than the model is trained on ({MAX_LABELS})")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = pa.array([features(t.decode("utf-8", "replace")) for t in texts(b, "t")], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in "lkh"), x], ["l", "k", "h", "x"])

    found = rows.join(F.broadcast(chosen), ["l", "k", "h"]).select("l", "k", "h", "t").mapInArrow(run, "l string, k bigint, h bigint, x binary")
    got = found.groupBy("l", "k", "h").agg(F.min("x").alias("x")).collect()
    got.sort(key=lambda r: (r["l"], r["k"]))
    return [bytes(r["x"]) for r in got], [r["l"] for r in got]


def fit_language_model(docs: DataFrame, **cols) -> LangModel:
    return train(*training_sample(docs, **cols))


def predict_language(docs: DataFrame, model: LangModel, *, text_col: str = "text", prefix: str = "lang_") -> DataFrame:
    """``docs`` with <prefix>pred, <prefix>score and <prefix>rejected (score below the calibrated threshold), which
    replace columns of these names."""
    docs = small_batches(docs)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<pred: string, score: double, rejected: boolean>")
    def predict(column: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = sent.value
        for texts in column:
            best, score = m.scores(list(texts))
            yield pd.DataFrame({"pred": [m.labels[b] if b >= 0 else "und" for b in best], "score": score, "rejected": (best < 0) | (score < m.threshold)})

    return with_fields(docs, predict(F.col(text_col)), {f"{prefix}{c}": c for c in ("pred", "score", "rejected")})


def remainder(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod`` (null id: of the empty text)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(mod))
