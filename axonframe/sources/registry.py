"""Dataset descriptions, and pulling them: download the files of a level, convert, and skip what is done."""

from __future__ import annotations

import inspect
import json
from collections.abc import Callable, Collection, Mapping, Sequence
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import convert
from .store import download, input_record, parse_ref, read_excel, read_feather, read_tar_member, write_store

#: Levels in order; a level needs the files of those before it.
LEVELS = ("meta", "weights", "nt-probs", "synapses")


@dataclass(frozen=True)
class DataFile:
    """One released file: where it is, what it is for, and how it is verified. An archive names its members' roles."""

    name: str
    url: str
    role: str
    level: str = "meta"
    sha256: str | None = None
    md5_b64: str | None = None
    bytes: int | None = None
    #: Of an archive: the role of each member that is needed.
    members: Mapping[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.level not in LEVELS:
            raise ValueError(f"unknown level {self.level!r}; known: {LEVELS}")


@dataclass(frozen=True)
class Dataset:
    """A dataset version with its files and citations."""

    name: str
    version: str
    files: tuple[DataFile, ...]
    converter: str = "1"
    citations: tuple[str, ...] = ()

    @property
    def ref(self) -> str:
        return f"{self.name}@{self.version}"

    def up_to(self, level: str) -> list[DataFile]:
        """The files that ``level`` needs."""
        last = LEVELS.index(level)
        return [f for f in self.files if LEVELS.index(f.level) <= last]

    def by_role(self, role: str) -> DataFile:
        found = [f for f in self.files if f.role == role]
        if len(found) != 1:
            raise KeyError(f"{self.ref} has {len(found)} files of role {role!r}")
        return found[0]


@dataclass
class Registry:
    """Datasets by reference."""

    datasets: dict[str, Dataset] = field(default_factory=dict)

    @classmethod
    def load(cls, folder: str) -> Registry:
        """Every ``*.json`` or ``*.yaml`` description in a folder."""
        out = cls()
        for p in sorted(Path(folder).iterdir()):
            if p.suffix == ".json":
                out.add(json.loads(p.read_text()))
            elif p.suffix in (".yaml", ".yml"):
                import yaml

                out.add(yaml.safe_load(p.read_text()))
        return out

    def add(self, data: Mapping) -> Dataset:
        d = Dataset(data["name"], str(data["version"]), tuple(DataFile(**f) for f in data.get("files", ())), str(data.get("converter", "1")), tuple(data.get("citations", ())))
        self.datasets[d.ref] = d
        return d

    def list(self) -> list[str]:
        return sorted(self.datasets)

    def get(self, ref: str) -> Dataset:
        parse_ref(ref)
        if ref not in self.datasets:
            raise KeyError(f"unknown dataset {ref!r}; known: {self.list()}")
        return self.datasets[ref]


def pull(dataset: Dataset, cache: str, convert: Callable[[Dataset, Path, Path, Sequence[DataFile]], Mapping], *, level: str = "meta", force: bool = False, progress: Callable[[int], None] | None = None) -> Path:
    """Download what ``level`` needs and convert it unless a store of that level, of these inputs and of this
    converter is there. ``convert`` writes the store; ``pull.json`` is written last."""
    raw, store = Path(cache) / "raw" / dataset.name / dataset.version, Path(cache) / dataset.name / dataset.version
    raw.mkdir(parents=True, exist_ok=True)
    files = dataset.up_to(level)
    for f in files:
        download(f.url, str(raw / f.name), sha256=f.sha256, md5_b64=f.md5_b64, expected_bytes=f.bytes, progress=progress)
    state = {"converter": dataset.converter, "inputs": {f.name: input_record(str(raw / f.name))["sha256"] for f in files}}
    marker = store / "pull.json"
    if not force and marker.exists():
        old = json.loads(marker.read_text())
        enough = LEVELS.index(old["level"]) >= LEVELS.index(level)
        if enough and old["converter"] == state["converter"] and all(old["inputs"].get(k) == v for k, v in state["inputs"].items()):
            return store
    store.mkdir(parents=True, exist_ok=True)
    marker.unlink(missing_ok=True)
    counts = convert(dataset, raw, store, files)
    marker.write_text(json.dumps({**state, "level": level, "counts": dict(counts or {})}, indent=2))
    return store


def read_raw(spark: SparkSession, path: str, member: str | None = None) -> DataFrame:
    """A released file by its suffix. Columns of CSV files, archive members and workbooks are strings, which the
    converters cast, so that a 64-bit id never passes a floating-point number; a CSV has ``_row``, which grows with the place of a row
    in its file."""
    if member is not None:
        return read_tar_member(spark, path, member).withColumn("_row", F.monotonically_increasing_id())
    if path.endswith(".feather"):
        return read_feather(spark, path)
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    if path.endswith(".xlsx"):
        return read_excel(spark, path)
    if path.endswith((".csv", ".csv.gz")):
        return spark.read.csv(path, header=True).withColumn("_row", F.monotonically_increasing_id())
    raise ValueError(f"no reader for {path!r}")


def read_roles(spark: SparkSession, raw: Path, files: Sequence[DataFile], known: Collection[str]) -> dict[str, DataFrame]:
    """The tables of ``files`` below ``raw`` by role, as far as roles are ``known``; an archive gives one for each of its
    members."""
    parts = [(role, str(raw / f.name), member) for f in files for member, role in (f.members or {None: f.role}).items()]
    found: dict[str, DataFrame] = {}
    for role, path, member in parts:
        if role in found:
            raise ValueError(f"two files of role {role!r}")
        if role in known:
            found[role] = read_raw(spark, path, member)
    return found


def store_converter(spark: SparkSession) -> Callable[[Dataset, Path, Path, Sequence[DataFile]], Mapping]:
    """A ``convert`` for ``pull``: the dataset's converter gets each file as the argument that its role names, and its
    neurons and edges become the store."""

    def run(dataset: Dataset, raw: Path, store: Path, files: Sequence[DataFile]) -> Mapping:
        function = getattr(convert, f"convert_{dataset.name}", None)
        if function is None:
            raise KeyError(f"no converter for {dataset.name!r}")
        known = inspect.signature(function).parameters
        roles = read_roles(spark, raw, files, known)
        if missing := [k for k, p in known.items() if p.default is inspect.Parameter.empty and k not in roles]:
            raise ValueError(f"{dataset.ref} needs files of roles {missing}; pull a higher level")
        tables = function(**roles, **({"version": dataset.version} if "version" in known else {}))
        return write_store(tables[0], tables[1], str(store), {"dataset": dataset.name, "version": dataset.version, "citations": list(dataset.citations)}, *tables[2:])["counts"]

    return run
