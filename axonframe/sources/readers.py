"""Data sources for released files that Spark has no reader for: Arrow IPC files and CSV members of tar archives.

Both open their file on the executors by a path or URI that these can read (``file:``, ``hdfs:``, ``s3:`` and so on),
give Arrow batches, and read the columns that are asked for. Nothing of the data passes the driver: for the schema it
reads the footer of an IPC file, or a member up to the end of its header.

Defined results: an empty file or member gives no rows; empty CSV fields are null; a column or member that is
missing is an error, and so is a field that its type can't hold."""

from __future__ import annotations

import codecs
import csv
import io
import tarfile
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
import pyarrow.csv as pacsv
import pyarrow.fs as pafs
import pyarrow.ipc as ipc
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

#: Record batches a task reads, and bytes of a CSV member that are parsed at once.
BATCHES = 8
BLOCK_BYTES = 8 << 20


def locate(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path within it of a URI or a plain path."""
    return pafs.FileSystem.from_uri(path if "://" in path else Path(path.removeprefix("file:")).absolute().as_uri())


@dataclass
class BatchRange(InputPartition):
    """Record batches from ``start`` up to ``end``."""

    start: int
    end: int


@contextmanager
def _open_ipc(path: str, fields: list[int] | None = None) -> Iterator[ipc.RecordBatchFileReader]:
    fs, name = locate(path)
    with fs.open_input_file(name) as f:
        yield ipc.open_file(f, options=ipc.IpcReadOptions(included_fields=fields))


def _plain(t: pa.DataType) -> pa.DataType:
    return t.value_type if pa.types.is_dictionary(t) else t


class ArrowFileSource(DataSource):
    """``axon_arrow``: an Arrow IPC (Feather) file; options ``path``, ``columns`` (comma-joined, all) and ``batches``,
    the record batches a task reads."""

    @classmethod
    def name(cls) -> str:
        return "axon_arrow"

    def schema(self) -> T.StructType:
        with _open_ipc(self.options["path"]) as r:
            have = r.schema
        names = self.options["columns"].split(",") if self.options.get("columns") else have.names
        if unknown := [c for c in names if c not in have.names]:
            raise KeyError(f"unknown columns: {unknown}")
        return from_arrow_schema(pa.schema([pa.field(c, _plain(have.field(c).type)) for c in names]))

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return ArrowFileReader(self.options["path"], int(self.options.get("batches", BATCHES)), schema)


class ArrowFileReader(DataSourceReader):
    def __init__(self, path: str, batches: int, schema: T.StructType) -> None:
        self.path, self.batches, self.want = path, batches, schema

    def partitions(self) -> list[BatchRange]:
        with _open_ipc(self.path) as r:
            n = r.num_record_batches
        return [BatchRange(i, min(i + self.batches, n)) for i in range(0, max(n, 1), self.batches)]

    def read(self, partition: BatchRange) -> Iterator[pa.RecordBatch]:
        target = to_arrow_schema(self.want)
        with _open_ipc(self.path) as r:
            fields = sorted(r.schema.get_field_index(c) for c in target.names)
        with _open_ipc(self.path, fields) as r:
            for i in range(partition.start, partition.end):
                b = r.get_batch(i)
                yield pa.RecordBatch.from_arrays([b.column(c).cast(target.field(c).type) for c in target.names], schema=target)


@contextmanager
def _open_member(path: str, member: str) -> Iterator[io.BufferedIOBase]:
    """The first file of that name, in whatever folder of the archive, as a stream that is read forwards only."""
    fs, name = locate(path)
    with fs.open_input_stream(name, compression=None) as raw, tarfile.open(fileobj=raw, mode="r|*") as tar:
        for m in tar:
            if m.isfile() and m.name.rsplit("/", 1)[-1] == member:
                yield tar.extractfile(m)
                return
        raise FileNotFoundError(f"no {member} in {path}")


class TarCsvSource(DataSource):
    """``axon_tar``: a CSV member, with a header, of a tar archive of any compression; options ``path`` and ``member``.
    Without a schema all its columns are strings. A compressed archive can't be split, so one task streams it, in
    blocks of ``BLOCK_BYTES``."""

    @classmethod
    def name(cls) -> str:
        return "axon_tar"

    def schema(self) -> T.StructType:
        with _open_member(self.options["path"], self.options["member"]) as f:
            header = next(csv.reader(codecs.getreader("utf-8-sig")(f)), [])
        return T.StructType([T.StructField(c, T.StringType()) for c in header])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return TarCsvReader(self.options["path"], self.options["member"], schema)


class TarCsvReader(DataSourceReader):
    def __init__(self, path: str, member: str, schema: T.StructType) -> None:
        self.path, self.member, self.want = path, member, schema

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        target = to_arrow_schema(self.want)
        if not target.names:
            return
        how = pacsv.ConvertOptions(column_types=target, include_columns=target.names, null_values=[""], strings_can_be_null=True)
        with _open_member(self.path, self.member) as f:
            rows = pacsv.open_csv(
                f,
                read_options=pacsv.ReadOptions(block_size=BLOCK_BYTES, use_threads=False),
                parse_options=pacsv.ParseOptions(newlines_in_values=True),
                convert_options=how,
            )
            for b in rows:
                yield pa.RecordBatch.from_arrays([b.column(c) for c in target.names], schema=target)
