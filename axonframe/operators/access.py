"""Driver-line catalogues and image matches."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import glob_regex, published_name


def selected(neurons: DataFrame, *, ids: Sequence[int] | None = None, globs: Mapping[str, str] | None = None) -> DataFrame:
    """Neurons of a selection, as a frame: those of an id list, which must exist, or those that match all globs."""
    from .graph import id_frame

    if ids is not None:
        asked = id_frame(neurons, ids, "neuron_id")
        missing = [r[0] for r in asked.join(neurons.select("neuron_id"), "neuron_id", "left_anti").orderBy("neuron_id").limit(10).collect()]
        if missing:
            raise KeyError(f"unknown ids: {missing}")
        return neurons.join(asked, "neuron_id", "left_semi")
    rows = neurons
    for column, pattern in (globs or {}).items():
        rows = rows.where(F.coalesce(F.col(column).cast("string").rlike(glob_regex(pattern)), F.lit(False)))
    return rows


def resolve_selection(neurons: DataFrame, *, ids: Sequence[int] | None = None, globs: Mapping[str, str] | None = None, limit: int = 5_000_000) -> list[int]:
    """Sorted ids of a selection (at most ``limit``; larger ones stay frames, see ``selected``); none is an error."""
    rows = selected(neurons, ids=ids, globs=globs).select("neuron_id").distinct().orderBy("neuron_id").limit(limit + 1).collect()
    if not rows:
        raise ValueError(f"the selection {dict(globs or {})} is empty")
    if len(rows) > limit:
        raise ValueError(f"the selection has more than {limit} neurons; use selected")
    return [r[0] for r in rows]


def lines_for_type(lines: DataFrame, pattern: str, *, min_quality: float | None = None) -> DataFrame:
    """Lines of which a cell type matches the glob, best quality first (nulls last), ties by line."""
    hit = lines.where(F.exists("cell_types", lambda t: t.rlike(glob_regex(pattern))))
    if min_quality is not None:
        hit = hit.where(F.col("quality") <= min_quality)
    return hit.withColumn("specific", F.size("cell_types") == 1).orderBy(F.asc_nulls_last("quality"), "line")


def types_for_line(lines: DataFrame, line: str) -> list[str]:
    row = lines.where(F.col("line") == line).select("cell_types").first()
    if row is None:
        raise KeyError(line)
    return row["cell_types"]


def lines_for_body(lines: DataFrame, body: int) -> DataFrame:
    return lines.where(F.array_contains("em_body_ids", F.lit(body)))


def attach_lines(hits: DataFrame, lines: DataFrame, *, max_lines: int = 5) -> DataFrame:
    """``hits`` (candidate label) with ``lines`` (best quality first, then specific, then name) and
    ``line_match`` (exact, glob or none); a type that extends the label counts as a glob match."""
    kinds = lines.select("line", "quality", (F.size("cell_types") == 1).alias("specific"), F.explode("cell_types").alias("t"))
    labels = hits.select("label").distinct()
    exact = labels.join(kinds, F.col("label") == F.col("t")).select("label", "line", "quality", "specific", F.lit("exact").alias("kind"))
    # Types that extend a label have one of the labels' lengths as a prefix: an equi-join on the prefix.
    lengths = [r["n"] for r in labels.where("label is not null").select(F.length("label").alias("n")).distinct().collect()]
    cut = kinds.withColumn("p", F.explode(F.transform(F.lit(lengths).cast("array<int>"), lambda n: F.when(n < F.length("t"), F.substring(F.col("t"), F.lit(1), n))))) if lengths else kinds.withColumn("p", F.lit(None).cast("string"))
    loose = labels.join(cut.where("p is not null"), F.col("label") == F.col("p")).select("label", "line", "quality", "specific", F.lit("glob").alias("kind"))
    loose = loose.join(exact.select("label").distinct(), "label", "left_anti")
    order = F.struct(F.col("quality").isNull().alias("q0"), "quality", (~F.col("specific")).alias("s"), "line")
    best = exact.unionByName(loose).dropDuplicates(["label", "line"]).groupBy("label").agg(F.slice(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["line"]), 1, max_lines).alias("lines"), F.first("kind").alias("line_match"))
    return hits.join(best, "label", "left").withColumn("line_match", F.coalesce("line_match", F.lit("none")))


def best_matches(results: DataFrame, *, direction: str) -> DataFrame:
    """Best image match per body or line from records (image.publishedName, normalizedScore, matchingPixels,
    mirrored): greatest score and pixels, number, whether any is mirrored."""
    name = published_name(F.col("image.publishedName"))
    rows = results.select(name.alias("n"), F.col("image.libraryName").alias("library"), "normalizedScore", "matchingPixels", "mirrored")
    key = F.col("n.name").alias("line" if direction == "em_to_lm" else "body")
    return rows.groupBy(key, "library").agg(F.max("normalizedScore").alias("score"), F.max("matchingPixels").alias("pixels"), F.count("*").alias("n_matches"), F.bool_or("mirrored").alias("mirrored")).orderBy(F.desc("score"))


def cached_json(path: str, fetch, *, refresh: bool = False) -> dict:
    """A JSON document from a file cache, fetched and stored if it is not there."""
    import json
    from pathlib import Path

    p = Path(path)
    if refresh or not p.exists():
        p.parent.mkdir(parents=True, exist_ok=True)
        part = p.with_suffix(".part")
        part.write_text(json.dumps(fetch()))
        part.replace(p)
    return json.loads(p.read_text())


def off_target_count(cache: str, images: Sequence[str], *, max_images: int = 50) -> int | None:
    """Distinct bodies that a line's images match, from cached records; None unless every file is cached."""
    import json
    from pathlib import Path

    files = [Path(cache) / f"{i}.json" for i in images[:max_images]]
    if not files or not all(f.exists() for f in files):
        return None
    names = {r["image"]["publishedName"] for f in files for r in json.loads(f.read_text()).get("results", [])}
    return len(names)
