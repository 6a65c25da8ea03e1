"""Bounded-memory ingestion of edge files as they arrive, with totals that are kept up to date.

Every batch is written as partial sums per pair, then its keys are merged into versioned totals: a version holds
``BUCKETS`` folders by a hash of the pair, a batch rewrites the buckets that it touches, and a manifest, written last,
names the folder of each bucket. Reading totals thus reads one folder a bucket, whatever the number of batches.

Every file counts once: the manifest names the last batch it holds. A batch that is run again after a failure
overwrites its own folders; one that the manifest has is left alone. Folders of older versions stay readable until
``clear_versions``."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import EDGES

KEY = ("dataset", "version", "pre", "post")
TOTALS = "dataset string, version string, pre bigint, post bigint, weight bigint"
BUCKETS = 64


def _sums(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEY).agg(F.sum("weight").cast("long").alias("weight"))


def _bucket(buckets: int):
    return F.pmod(F.xxhash64(*KEY), F.lit(buckets)).cast("int")


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def manifest(spark: SparkSession, sink: str, buckets: int | None = None) -> dict:
    """The totals' last state: batch (-1 before the first), buckets (``buckets`` before the first), and folders by bucket."""
    p, fs = _path(spark, f"{sink.rstrip('/')}/totals")
    names = [str(s.getPath().getName()) for s in fs.listStatus(p)] if fs.exists(p) else []
    found = [int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json")]
    if not found:
        return {"batch": -1, "buckets": buckets or BUCKETS, "folders": {}}
    text = spark.read.text(f"{sink.rstrip('/')}/totals/manifest-{max(found)}.json", wholetext=True).first()[0]
    return json.loads(text)


def _publish(spark: SparkSession, sink: str, state: dict) -> None:
    """Write the manifest beside its place and rename it, so that a reader sees all of it or none."""
    final, fs = _path(spark, f"{sink}/totals/manifest-{state['batch']}.json")
    draft, _ = _path(spark, f"{sink}/totals/draft-{state['batch']}.json")
    out = fs.create(draft, True)
    try:
        out.write(bytearray(json.dumps(state).encode()))
    finally:
        out.close()
    if not fs.rename(draft, final):
        raise OSError(f"could not publish {final}")


def merge_batch(spark: SparkSession, sink: str, number: int, buckets: int | None = None) -> None:
    """Merge the partial sums of batch ``number`` into the totals of the buckets it touches; nothing is done if the totals
    have it already."""
    sink = sink.rstrip("/")
    state = manifest(spark, sink, buckets)
    if number <= state["batch"]:
        return
    batch = spark.read.parquet(f"{sink}/batch={number}").withColumn("bucket", _bucket(state["buckets"]))
    touched = sorted(r["bucket"] for r in batch.select("bucket").distinct().collect())  # at most ``buckets`` numbers
    if touched:
        old = [state["folders"][str(b)] for b in touched if str(b) in state["folders"]]
        rows = batch.select(*KEY, F.col("weight").cast("long").alias("weight"))
        if old:
            rows = rows.unionByName(spark.read.schema(TOTALS).parquet(*(f"{sink}/totals/{f}" for f in old)))
        folder = f"version-{number}"
        _sums(rows).withColumn("bucket", _bucket(state["buckets"])).repartition("bucket").sortWithinPartitions("bucket", "pre", "post").write.mode("overwrite").partitionBy("bucket").parquet(f"{sink}/totals/{folder}")
        state["folders"] |= {str(b): f"{folder}/bucket={b}" for b in touched}
    _publish(spark, sink, {**state, "batch": number})


def stream_edges(spark: SparkSession, source: str, sink: str, checkpoint: str, *, files_per_trigger: int = 100, buckets: int | None = None) -> None:
    """Take all edge files now in ``source`` (Parquet), append the sums per pair of every batch to ``sink`` and merge them
    into its totals; files that an earlier call has taken are skipped by the checkpoint. The first call fixes the number of ``buckets``:
    a bucket is merged by one task, so take one per million pairs or so of the whole graph."""
    rows = spark.readStream.schema(EDGES).option("maxFilesPerTrigger", files_per_trigger).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        # The folder of a batch is overwritten if the batch is run again, so every file counts once.
        _sums(batch).write.mode("overwrite").parquet(f"{sink.rstrip('/')}/batch={number}")
        merge_batch(spark, sink, number, buckets)

    rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def merged_edges(spark: SparkSession, sink: str) -> DataFrame:
    """Edges over all batches from the last totals: no sums are made again."""
    state = manifest(spark, sink)
    if not state["folders"]:
        return spark.createDataFrame([], TOTALS)
    return spark.read.schema(TOTALS).parquet(*(f"{sink.rstrip('/')}/totals/{f}" for f in state["folders"].values()))


def clear_versions(spark: SparkSession, sink: str) -> None:
    """Delete bucket folders and manifests that the last manifest doesn't need, when nobody reads them any more."""
    sink = sink.rstrip("/")
    state = manifest(spark, sink)
    used = set(state["folders"].values())
    root, fs = _path(spark, f"{sink}/totals")
    for s in fs.listStatus(root) if fs.exists(root) else []:
        name = str(s.getPath().getName())
        if name.startswith("version-"):
            inside = {f"{name}/{x.getPath().getName()}": x.getPath() for x in fs.listStatus(s.getPath())}
            for key, path in inside.items():
                if "/bucket=" in key and key not in used:
                    fs.delete(path, True)
            if not any(key in used for key in inside):
                fs.delete(s.getPath(), True)
        elif name != f"manifest-{state['batch']}.json":
            fs.delete(s.getPath(), True)
