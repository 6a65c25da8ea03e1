"""Permutation tests of many types between two datasets at once: the type and the permutation are columns.

``compare.compare_type`` holds the matrix of one type; here nothing but the pairs' table has a row per type, and no
matrix is made. A neuron's dataset is permuted within its type and side by the ranks of hashes, so that groups keep
their sizes; the flags of all permutations travel with the neuron as one array, and its shares are multiplied out only
where they are summed. All statistics come from two aggregates, one per label and one per type and permutation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import cosine, hash_uniform, verdict
from .compare import partner_labels, profile_rows
from .graph import Graph
from .paths import settle

GROUPS = [(ds, side) for ds in "ab" for side in ("left", "right")]
#: Statistics that differ by less are ties, which count for the null; a spread below it has no z.
TIE = 1e-9


def _members(graph: Graph, pairs: DataFrame, column: str, ds: str) -> DataFrame:
    """(type_a, type_b, ds, neuron_id, side): left and right neurons of each pair."""
    nodes = graph.nodes.where(F.col("side").isin("left", "right")).select(F.col("cell_type").alias(column), "neuron_id", "side")
    return pairs.join(nodes, column).select("type_a", "type_b", F.lit(ds).alias("ds"), "neuron_id", "side")


def permuted_members(members: DataFrame, n_permutations: int, seed: int) -> DataFrame:
    """``members`` with ``flags``, an array of whether the neuron counts for ``a``: first as it is, then in each
    permutation, where the least hashes of a type and side do, as many as it has neurons in ``a``."""
    group = W.partitionBy("type_a", "type_b", "side")
    n_a = F.count_if(F.col("ds") == "a").over(group)
    rows = members.withColumn("n_a", n_a).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n_permutations))))
    rows = rows.withColumn("u", hash_uniform(F.lit(seed), F.col("k"), F.col("ds"), F.col("neuron_id")))
    rank = F.row_number().over(W.partitionBy("type_a", "type_b", "side", "k").orderBy("u", "ds", "neuron_id"))
    rows = rows.withColumn("flag", F.when(F.col("k") == 0, F.col("ds") == "a").otherwise(rank <= F.col("n_a")))
    flags = F.transform(F.sort_array(F.collect_list(F.struct("k", "flag"))), lambda x: x["flag"])
    return rows.groupBy("type_a", "type_b", "side", "ds", "neuron_id").agg(flags.alias("flags"))


def _mean(ds: str, side: str | None = None) -> Column:
    """Mean share of a label over a dataset's neurons, of one side or both; null without neurons."""
    sides = [side] if side else ["left", "right"]
    total = sum((F.col(f"s_{ds}_{s}") for s in sides), F.lit(0.0))
    n = sum((F.col(f"n_{ds}_{s}") for s in sides), F.lit(0))
    return F.when(n > 0, total / n)


def _apart(u: Column, v: Column) -> Column:
    """1 - cosine of two vectors given by their entries; null without neurons, 1 if a vector is zero."""
    c = cosine(F.sum(u * v), F.sum(u * u), F.sum(v * v))
    return F.when(F.count(u * v) > 0, 1 - F.coalesce(c, F.lit(0.0)))


def compare_types(a: Graph, b: Graph, pairs: DataFrame, *, direction: str = "out", n_permutations: int = 1000, seed: int = 0, labels: tuple[DataFrame, DataFrame] | None = None, alpha: float = 0.05) -> DataFrame:
    """One row per distinct (type_a, type_b) of ``pairs``: n_a, n_b, statistic, between, within, z, p, verdict, unmatched_a,
    unmatched_b.

    The statistic is that of ``compare.type_statistic``; p counts permutations that reach it, ties included, and itself;
    z is 0 where the null does not vary. A pair without left or right neurons in one of the datasets has no statistic,
    p or verdict, and neither has one whose neurons have no named partners in either; null types match nothing. Hashes
    make results independent of partitions."""
    if n_permutations < 1:
        raise ValueError("n_permutations must be >= 1")
    keys = ["type_a", "type_b"]
    pairs = settle(pairs.select(*keys).distinct())
    names = labels or (partner_labels(a.nodes), partner_labels(b.nodes))
    members = settle(_members(a, pairs, "type_a", "a").unionByName(_members(b, pairs, "type_b", "b")))
    of = lambda ds: members.where(F.col("ds") == ds).select("neuron_id", "side").distinct()
    shares = [profile_rows(g, of(ds), direction=direction, labels=x).withColumn("ds", F.lit(ds)) for g, ds, x in zip((a, b), "ab", names, strict=True)]
    rows = settle(shares[0].unionByName(shares[1]).drop("side"))

    sizes = members.groupBy(*keys).agg(*(F.count_if((F.col("ds") == ds) & (F.col("side") == side)).alias(f"n_{ds}_{side}") for ds, side in GROUPS))
    lost = rows.select("ds", "neuron_id", "unmatched").distinct().join(members, ["ds", "neuron_id"]).groupBy(*keys)
    lost = lost.agg(*(F.avg(F.when(F.col("ds") == ds, F.col("unmatched"))).alias(f"unmatched_{ds}") for ds in "ab"))
    sums = (
        rows.where("label is not null").select("ds", "neuron_id", "label", "value").join(permuted_members(members, n_permutations, seed), ["ds", "neuron_id"])
        .select(*keys, "side", "label", "value", F.posexplode("flags").alias("k", "flag"))
        .groupBy(*keys, "k", "label")
        .agg(*(F.sum(F.when((F.col("flag") == (ds == "a")) & (F.col("side") == side), F.col("value")).otherwise(0.0)).alias(f"s_{ds}_{side}") for ds, side in GROUPS))
    )
    apart = sums.join(sizes, keys).groupBy(*keys, "k").agg(
        _apart(_mean("a"), _mean("b")).alias("between"),
        *(_apart(_mean(ds, "left"), _mean(ds, "right")).alias(f"within_{ds}") for ds in "ab"),
    )
    have = F.filter(F.array("within_a", "within_b"), lambda x: x.isNotNull())
    within = F.when(F.size(have) > 0, F.aggregate(have, F.lit(0.0), lambda t, x: t + x) / F.size(have)).otherwise(0.0)
    stats = apart.where("between is not null").withColumn("within", within).withColumn("statistic", F.col("between") - F.col("within"))
    null, seen = F.col("k") > 0, lambda c: F.max(F.when(F.col("k") == 0, F.col(c)))
    # The null's moments and the count of ties need the observed value, so it goes beside each permutation.
    tested = stats.withColumn("observed", seen("statistic").over(W.partitionBy(*keys))).groupBy(*keys).agg(
        *(seen(c).alias(c) for c in ("statistic", "between", "within")),
        F.avg(F.when(null, F.col("statistic"))).alias("_mean"),
        F.coalesce(F.stddev_samp(F.when(null, F.col("statistic"))), F.lit(0.0)).alias("_sd"),
        ((F.count_if(null & (F.col("statistic") >= F.col("observed") - TIE)) + 1) / F.lit(n_permutations + 1)).alias("p"),
    )
    z = F.when(F.col("_sd") > TIE, (F.col("statistic") - F.col("_mean")) / F.col("_sd")).otherwise(0.0)
    tested = tested.select(*keys, "statistic", "between", "within", z.alias("z"), "p", verdict(F.col("p"), F.col("statistic"), alpha=alpha).alias("verdict"))
    both = lambda ds: (F.coalesce(f"n_{ds}_left", F.lit(0)) + F.coalesce(f"n_{ds}_right", F.lit(0))).cast("long").alias(f"n_{ds}")
    out = pairs
    for df in (sizes, lost, tested):
        df = df.withColumnsRenamed({c: f"_{c}" for c in keys})
        out = out.join(df, F.col("type_a").eqNullSafe(F.col("_type_a")) & F.col("type_b").eqNullSafe(F.col("_type_b")), "left").drop("_type_a", "_type_b")
    return out.select(*keys, both("a"), both("b"), "statistic", "between", "within", "z", "p", "verdict", "unmatched_a", "unmatched_b")
