"""Stores of harmonised tables: SQL views, scans, readers of released formats, Parquet and JSON sinks."""

from __future__ import annotations

import base64
import datetime
import hashlib
import json
import urllib.request
import uuid
from collections.abc import Callable, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graph import among
from ..schema import EDGES
from .readers import ArrowFileSource, TarCsvSource

TABLES = ("neurons", "edges", "edges_roi")


def neuron_scan(neurons: DataFrame, *, columns: Sequence[str] | None = None, where: str | None = None) -> DataFrame:
    """Projection (names checked) and a raw WHERE text, ordered by id."""
    if columns is not None:
        unknown = [c for c in columns if c not in neurons.columns]
        if unknown:
            raise KeyError(f"unknown columns: {unknown}")
    out = neurons.where(F.expr(where)) if where else neurons
    out = out.orderBy("neuron_id")
    return out.select(*columns) if columns is not None else out


def edge_scan(edges: DataFrame, *, min_weight: int = 1, pre: Sequence[int] | None = None, post: Sequence[int] | None = None, ordered: bool = False) -> DataFrame:
    """Rows at ``min_weight`` or more, optionally only with pre or post among ids."""
    out = edges.where(F.col("weight") >= min_weight)
    for name, ids in (("pre", pre), ("post", post)):
        if ids is not None:
            out = among(out, name, ids)
    return out.orderBy("pre", "post") if ordered else out


class Store:
    """A read-only handle on one dataset version: a folder of Parquet tables with ``provenance.json``."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        try:
            rows = spark.read.text(f"{self.root}/provenance.json", wholetext=True).collect()
        except Exception as e:
            raise FileNotFoundError(f"no provenance.json in {root}") from e
        self.provenance = json.loads(rows[0][0])
        self.views = {}
        prefix = "s" + uuid.uuid4().hex[:8]
        for t in TABLES:
            try:
                df = spark.read.parquet(f"{self.root}/{t}.parquet")
            except Exception:  # noqa: BLE001  a store need not have every table
                continue
            df.createOrReplaceTempView(f"{prefix}_{t}")
            self.views[t] = f"{prefix}_{t}"

    @classmethod
    def open(cls, spark: SparkSession, ref: str, cache: str) -> Store:
        """The cached store of ``name@version``."""
        name, version = parse_ref(ref)
        return cls(spark, f"{cache.rstrip('/')}/{name}/{version}")

    def table(self, name: str) -> DataFrame:
        return self.spark.table(self.views[name])

    def query(self, sql: str, params: Sequence | None = None) -> DataFrame:
        """Any SQL over the views, named as ``{neurons}``, ``{edges}`` or ``{edges_roi}``, with ``?`` parameters."""
        return self.spark.sql(sql.format(**self.views), args=list(params) if params else None)

    def neurons(self, columns: Sequence[str] | None = None, where: str | None = None) -> DataFrame:
        return neuron_scan(self.table("neurons"), columns=columns, where=where)

    def edges(self, *, min_weight: int = 1, pre: Sequence[int] | None = None, post: Sequence[int] | None = None) -> DataFrame:
        if "edges" not in self.views:
            return self.spark.createDataFrame([], EDGES)
        return edge_scan(self.table("edges"), min_weight=min_weight, pre=pre, post=post, ordered=True)

    def citation_text(self) -> str:
        return "\n".join(self.provenance.get("citations", []))

    @property
    def fingerprint(self) -> str:
        """SHA-256 over the provenance, for resuming runs."""
        return hashlib.sha256(json.dumps(self.provenance, sort_keys=True).encode()).hexdigest()


def parse_ref(ref: str) -> tuple[str, str]:
    name, at, version = ref.partition("@")
    if not (name and at and version):
        raise ValueError(f"expected name@version, got {ref!r}")
    return name, version


# Readers.


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV (also .gz) with a header and an explicit schema, so that ids stay 64-bit integers."""
    return spark.read.csv(path, header=True, schema=schema)


def read_tar_member(spark: SparkSession, path: str, member: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A CSV inside a tar archive, streamed by the executor that reads it; without a schema all columns are strings."""
    spark.dataSource.register(TarCsvSource)
    reader = spark.read.format("axon_tar").options(path=path, member=member)
    return (reader.schema(schema) if schema is not None else reader).load()


def read_feather(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """An Arrow IPC file: a task reads a few record batches, and of these the given columns only."""
    spark.dataSource.register(ArrowFileSource)
    return spark.read.format("axon_arrow").options(path=path, columns=",".join(columns or ())).load()


def read_excel(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A catalogue that is published as a workbook (thousands of rows, read by the driver; needs ``openpyxl``); without
    a schema all columns are strings."""
    import pandas as pd

    if schema is None:
        schema = T.StructType([T.StructField(str(c), T.StringType()) for c in pd.read_excel(path, dtype=str, nrows=0).columns])
    names = T.StructType.fromDDL(schema).names if isinstance(schema, str) else schema.names
    rows = pd.read_excel(path, dtype=str)[names]
    return spark.createDataFrame(rows.astype(object).where(rows.notna(), None).values.tolist(), ", ".join(f"`{n}` string" for n in names)).select(*(F.col(f.name).try_cast(f.dataType).alias(f.name) for f in (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema)))


def open_lines(spark: SparkSession, root: str) -> DataFrame:
    """The driver-line catalogue that ``write_lines`` has stored below ``root``."""
    return spark.read.parquet(f"{root.rstrip('/')}/lines.parquet")


def write_lines(lines: DataFrame, root: str) -> None:
    write_parquet(lines, f"{root.rstrip('/')}/lines.parquet", ("line",))


def read_json_records(spark: SparkSession, path: str) -> DataFrame:
    """Match records (``results`` arrays of JSON documents), one row per record."""
    return spark.read.json(path, multiLine=True).select(F.explode("results").alias("r")).select("r.*")


# Sinks.


def write_parquet(df: DataFrame, path: str, order: Sequence[str] = ("pre", "post")) -> None:
    """zstd Parquet, sorted inside files by the given columns where the table has them."""
    keys = [c for c in order if c in df.columns]
    (df.sortWithinPartitions(*keys) if keys else df).write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_store(neurons: DataFrame, edges: DataFrame, root: str, provenance: dict, edges_roi: DataFrame | None = None) -> dict:
    """Write a store and its provenance with row counts; returns the provenance."""
    spark, root = neurons.sparkSession, root.rstrip("/")
    tables = {"neurons": neurons, "edges": edges} | ({"edges_roi": edges_roi} if edges_roi is not None else {})
    for name, df in tables.items():
        write_parquet(df, f"{root}/{name}.parquet", ("neuron_id",) if name == "neurons" else ("pre", "post"))
    counts = {name: spark.read.parquet(f"{root}/{name}.parquet").count() for name in tables}
    record = {**provenance, "counts": counts, "created": datetime.datetime.now(datetime.UTC).isoformat(timespec="seconds")}
    jvm, path = spark._jvm, f"{root}/provenance.json"
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(json.dumps(record, indent=2).encode()))
    finally:
        out.close()
    return record


def input_record(path: str) -> dict:
    """Name, size and SHA-256 of an input file."""
    h = hashlib.sha256()
    with Path(path).open("rb") as f:
        while block := f.read(1 << 20):
            h.update(block)
    return {"name": Path(path).name, "bytes": Path(path).stat().st_size, "sha256": h.hexdigest()}


def download(url: str, dest: str, *, sha256: str | None = None, md5_b64: str | None = None, expected_bytes: int | None = None, timeout: int = 60, progress: Callable[[int], None] | None = None) -> Path:
    """Fetch into ``dest``, resuming a ``.part`` file by a range request; the file is verified by size, SHA-256
    and MD5, and a mismatch removes it. A verified file is not fetched again."""
    target, part = Path(dest), Path(dest + ".part")

    def good(p: Path) -> bool:
        if not p.exists() or (expected_bytes is not None and p.stat().st_size != expected_bytes):
            return False
        if sha256 and input_record(str(p))["sha256"] != sha256:
            return False
        return not md5_b64 or base64.b64encode(hashlib.md5(p.read_bytes()).digest()).decode() == md5_b64  # noqa: S324

    if good(target):
        return target
    have = part.stat().st_size if part.exists() else 0
    request = urllib.request.Request(url, headers={"Range": f"bytes={have}-"} if have else {})  # noqa: S310
    with urllib.request.urlopen(request, timeout=timeout) as r, part.open("ab" if r.status == 206 else "wb") as f:  # noqa: S310
        while block := r.read(1 << 20):
            f.write(block)
            if progress:
                progress(f.tell())
    if not good(part):
        part.unlink()
        raise ValueError(f"{url} does not match its checksum")
    part.replace(target)
    return target
