"""A Merkle manifest of a documents table: digests of rows, a tree per language, a proof for every row.

Method: leaves get their places in their tree by a range sort, are collected in blocks of a fixed size (``BLOCK``
leaves, three levels of the tree), and higher-order functions collapse a block's levels natively. Block roots are
the leaves of the next round, with known places, until each tree has one node; the trees' roots are then
the leaves of one more tree. On the way back each block hands its nodes their siblings of all levels above, so that a
proof is folded where the leaves are, and only block rows are joined.

Defined results: a field that is null enters a leaf as ``-``; null ids stand last in their tree, rows that agree in id
by their digests; equal rows are leaves of their own; a null language has a tree of its own, the first one; a row with
a null id is never tampered with; other columns, whatever their names, are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ascii_lower, settle

#: Children of a node, levels that a block spans, and leaves of a block.
FANOUT = 8
LEVELS = 3
BLOCK = FANOUT**LEVELS
#: Fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(*fields: Column) -> Column:
    """SHA-256 of the fields, each with its UTF-8 length before it."""
    shown = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")) for s in shown)), 256)


def numbered(rows: DataFrame, tree: str, *order: Column) -> DataFrame:
    """``rows`` with ``pos`` (from 0, in order of ``order`` inside the tree) and ``total`` (rows of the tree).

    A range sort deals the rows; a row's place in its partition and the counts of the partitions before give its place,
    so that a tree of any size is spread over all tasks. Placed rows are settled, as a repeated sort could cut them
    elsewhere."""
    by = [F.col(tree).asc_nulls_first(), *order]
    in_part = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = settle(rows.repartitionByRange(*by).sortWithinPartitions(*by).select("*", F.spark_partition_id().alias("part"), in_part.alias("at")))
    runs = placed.groupBy(F.col("part").alias("r_part"), F.col(tree).alias("r_tree")).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    # One row per partition and tree in it, so at most partitions + trees rows.
    own = W.partitionBy("r_tree")
    before = F.sum("n").over(own.orderBy("r_part").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n")
    runs = runs.select("r_part", "r_tree", (before - F.col("first")).alias("shift"), F.sum("n").over(own).alias("total"))
    placed = placed.join(runs, (F.col("part") == F.col("r_part")) & F.col(tree).eqNullSafe(F.col("r_tree")))
    return placed.select(*rows.columns, (F.col("at") + F.col("shift")).alias("pos"), "total")


def _parents(nodes: Column) -> Column:
    """The next level: a digest of every ``FANOUT`` consecutive nodes."""
    runs = F.sequence(F.lit(0), F.ceil(F.size(nodes) / FANOUT).cast("int") - 1)
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(nodes, i * FANOUT + 1, FANOUT), ""), 256))


def _depth(total: Column) -> Column:
    """Levels of a block that are collapsed in a tree of ``total`` nodes."""
    depth = F.lit(LEVELS)
    for k in reversed(range(LEVELS)):
        depth = F.when(total <= FANOUT**k, k).otherwise(depth)
    return depth


def _siblings(levels: Column, at: Column) -> Column:
    """(left, right) of each collapsed level: what stands beside the ancestor of the block's node ``at`` in its run."""

    def side(level: Column, k: Column) -> Column:
        j = F.shiftright(at, 0)
        for d in range(1, LEVELS):
            j = F.when(k == d, (at / FANOUT**d).cast("int")).otherwise(j)
        here = F.pmod(j, F.lit(FANOUT))
        left = F.array_join(F.slice(level, j - here + 1, here), "")
        return F.struct(left.alias("left"), F.array_join(F.slice(level, j + 2, FANOUT - 1 - here), "").alias("right"))

    return F.transform(F.slice(levels, 1, F.size(levels) - 1), side)


def climb(nodes: DataFrame, finish: Callable[[DataFrame], DataFrame], kept: tuple[str, ...] = ()) -> DataFrame:
    """Collapse every tree of ``nodes`` (tree, pos, total, digest and the columns ``kept``) to one node.

    ``finish`` gets (tree, digest) of the trees' roots and returns (tree, path, and what else it knows of a tree). The
    result has a row per node: tree, ``kept``, digest, ``path`` (siblings of all levels from the node up, as (left, right)), and
    what ``finish`` added."""
    blocks = nodes.groupBy("tree", F.floor(F.col("pos") / BLOCK).alias("block")).agg(F.max("total").alias("total"), F.array_sort(F.collect_list(F.struct("pos", "digest", *kept))).alias("nodes"))
    blocks = settle(blocks)
    levels = F.aggregate(
        F.slice(F.array(*(F.lit(k) for k in range(LEVELS))), 1, _depth(F.col("total"))), F.array(F.col("nodes.digest")), lambda done, _: F.concat(done, F.array(_parents(F.element_at(done, -1))))
    )
    blocks = blocks.withColumn("levels", levels)
    roots = blocks.select("tree", F.col("block").alias("pos"), F.ceil(F.col("total") / BLOCK).alias("total"), F.element_at(F.element_at("levels", -1), 1).alias("digest"))
    if (blocks.agg(F.max("total")).head()[0] or 0) > BLOCK:
        above = climb(roots.withColumn("id", F.col("pos")), finish, ("id",)).withColumnRenamed("id", "a_block").drop("digest")
    else:
        above = finish(roots.select("tree", "digest")).withColumn("a_block", F.lit(0).cast("long"))
    above = above.withColumnsRenamed({"tree": "a_tree", "path": "a_path"})
    known = [c for c in above.columns if c not in ("a_tree", "a_path", "a_block")]
    joined = blocks.join(above, F.col("tree").eqNullSafe(F.col("a_tree")) & (F.col("block") == F.col("a_block")))
    row = lambda x, i: F.struct(x["digest"].alias("digest"), *(x[c].alias(c) for c in kept), F.concat(_siblings(F.col("levels"), i), F.col("a_path")).alias("path"))
    return joined.select("tree", *known, F.inline(F.transform("nodes", row)))


def _no_path() -> Column:
    return F.array().cast("array<struct<left:string,right:string>>")


def _join_trees(trees: DataFrame) -> DataFrame:
    """The tree over the roots of all trees: (tree, path, subroot, root)."""
    nodes = numbered(trees.select(F.lit(0).alias("one"), F.col("tree").alias("name"), "digest"), "one", F.col("name").asc_nulls_first())
    top = lambda roots: roots.select("tree", _no_path().alias("path"), F.col("digest").alias("root"))
    done = climb(nodes.select(F.col("one").alias("tree"), "pos", "total", "digest", "name"), top, ("name",))
    return done.select(F.col("name").alias("tree"), "path", F.col("digest").alias("subroot"), "root")


def fold(path: Column, leaf: Column) -> Column:
    """The root that ``leaf`` and the siblings in ``path`` lead to."""
    return F.aggregate(path, leaf, lambda node, p: F.sha2(F.concat(p["left"], node, p["right"]), 256))


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``tampered`` (a condition on the columns of ``docs``) names rows whose text is lower-cased (A-Z) before their proof
    is folded; the tree is that of the rows as they are."""
    fields = [F.col(c) for c in FIELDS]
    leaf = leaf_digest(*fields)
    changed = F.coalesce(tampered, F.lit(False)) if tampered is not None else F.lit(False)
    lower = ascii_lower(F.col("text"))
    other = F.when(changed & (lower != F.col("text")), leaf_digest(*fields[:-1], lower))
    rows = docs.select(F.col("lang").alias("tree"), "doc_id", leaf.alias("digest"), other.alias("other"))
    nodes = numbered(rows, "tree", F.col("doc_id").asc_nulls_last(), F.col("digest"))
    done = climb(nodes, _join_trees, ("doc_id", "other"))
    proof = F.sha2(F.array_join(F.transform("path", lambda p: F.concat(p["left"], p["right"])), ""), 256)
    done = done.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), fold(F.col("path"), F.coalesce("other", "digest")).alias("folded_root"))
    return done.withColumn("verified", F.col("folded_root") == F.col("root"))
