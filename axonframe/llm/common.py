"""Shared pieces of the text operators: word patterns, reading, shared-folder checkpoints, byte batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words is space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir`` (any path Spark can read)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of the words of ``text``; null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; other letters stay as they are."""
    return F.translate(text, UPPER, LOWER)


def let(value: Column, body) -> Column:
    """``body(v)`` with ``value`` computed once per row, also if ``body`` uses ``v`` often or in lambdas."""
    return F.transform(F.array(value), body)[0]


def with_fields(docs: DataFrame, value: Column, fields: dict[str, str]) -> DataFrame:
    """``docs`` with the fields of the struct ``value`` as columns (name to field); they replace columns of
    their names."""
    kept = [c for c in docs.columns if c not in fields]
    out = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)), value.alias("v"))
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(kept)), *(F.col(f"v.{field}").alias(c) for c, field in fields.items()))


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder that driver and executors share: below ``spark.checkpoint.dir``, which the cluster sets.
    Where it is unset, local mode gets a temporary folder for the session and a cluster an error."""
    return f"{_app_dir(spark)}/{uuid.uuid4().hex}"


def _app_dir(spark: SparkSession) -> str:
    """One folder per application, so that all it has settled can go at once."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.axonframe.local.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = "file://" + tempfile.mkdtemp(prefix="axonframe-")
        spark.conf.set("spark.axonframe.local.dir", top)
    return f"{top.rstrip('/')}/axonframe-{spark.sparkContext.applicationId}"


def clear_settled(spark: SparkSession) -> None:
    """Delete what the application has settled, when no DataFrame that reads it is needed any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_app_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends there, and a lost executor
    costs a reread instead of a recomputation. Files go with ``clear_settled``, or when the checkpoint folder is
    cleared."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The UTF-8 bytes of a string column; null is empty."""
    col = batch.column(batch.schema.get_field_index(column))
    out = col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).to_pylist()
    return [x or b"" for x in out]


def slices(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive items of at most ``limit`` bytes together (a larger item comes alone)."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if sizes:
        yield start, len(sizes)


#: Rows per Arrow batch for Python operators on whole texts (Spark's default of 10,000 holds too much text).
BATCH_ROWS = 1000


#: Bytes up to which the input of a Python operator is dealt over all cores, as a small file is one task.
SPREAD_BYTES = 32 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, with the session's Arrow batches cut to ``BATCH_ROWS`` rows, so that a Python worker holds little
    text at a time. A smaller setting of the session stays. Inputs of at most ``SPREAD_BYTES`` are dealt over
    all cores."""
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= SPREAD_BYTES:
        df = df.repartition(df.sparkSession.sparkContext.defaultParallelism)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(name, "10000")) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


_POW: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, (n + 1).bit_length())
    if size not in _POW:
        _POW.clear()
        up, down = np.full(size, _P), np.full(size, _P_INV)
        up[0] = down[0] = 1
        with np.errstate(over="ignore"):
            _POW[size] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _POW[size]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (xor-shift-multiply finaliser)."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the words in a byte buffer."""
    gap = np.empty(len(buf) + 2, bool)
    gap[0] = gap[-1] = True
    gap[1:-1] = _SPACE[buf]
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    return edge[::2], edge[1::2]


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, from prefix sums of a polynomial modulo 2**64.

    Two different words share a value with odds of about 2**-64 a pair."""
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(buf))
    with np.errstate(over="ignore"):
        total = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(mix64(buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=total[1:])
        h = (total[end] - total[start]) * down[start]
        return mix64(h ^ (np.uint64(0xD6E8FEB86659FD93) * (end - start).astype(np.uint64)))


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of ``n`` word hashes."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            out = mix64(out + h[j : len(h) - n + 1 + j] + np.uint64(n))
    return out
