"""Mixing sources to target weights by weighted fair queueing.

Method: the documents of a source are put in a seeded random order; a document's virtual finish time is the
source's cumulative words up to and with it, divided by the source's target. A source whose target exceeds
its size is passed over again (at most ``max_repeats`` passes), its clock running on. ``mix_stream`` has a row
for each pass of a document, range-sorts all sources' rows by finish time and cuts the stream at the total
budget, which is the words of all documents: the words of the range partitions give the partition in which the
budget ends, and there a running sum gives the row. As targets sum up to the budget and sources are served at rates
in proportion to their targets, each has had its target at virtual time 1; a document that is then in service has
finish time 1 and counts up to there, rounded up to words. The cut takes off what this rounding adds, so that the mix
has exactly the budget (but for rows of one key, which are taken alike).

No order within a source is made in one task. Keys are uniform hashes, so a source's documents fall into
even buckets by the top bits of the key; prefix sums over groups of buckets, over the buckets of a group and
within a bucket add up to each document's cumulative words. Only sizes and keys are shuffled; ``taken`` is summed
from the stream and joined to the documents by source, key and size.

Defined results: null text has size 0; a null source is a source, last in order; no words are taken from
documents of size 0; rows that agree in source, id and size share a key and are taken alike; null ids hash like an
empty string; an empty table gives no rows; extra columns are ignored, or kept as they are but for those with
the names of results, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, settle

#: Documents per bucket that the prefix sums aim at, and buckets per group; bits of a key.
BUCKET_ROWS = 128
GROUP_BITS = 10
KEY_HEX = 15
KEY_BITS = 4 * KEY_HEX
#: Sources up to which per-source tables are broadcast; more are joined by a shuffle.
BROADCAST_SOURCES = 100_000
#: Order of the stream, and the part of a word by which a target may exceed whole words.
STREAM_ORDER = ("finish", "key", "pass", "size", "source")
ROUNDING = 1e-6
SEED = "axon-mix-1"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def shuffle_key(doc_id: Column, size: Column, seed: str = SEED) -> Column:
    """A uniform unsigned 60-bit key, from an MD5 digest of the id and the size of a document alone."""
    text = F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), size)
    return F.conv(F.substring(F.md5(text), 1, KEY_HEX), 16, 10).cast("bigint")


def source_targets(sizes: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """Target tokens per source from ``sizes`` (source, source_size): shares of the total by weight, where no
    target exceeds ``max_repeats`` times its source's size and the excess goes to the others by weight.

    Sources stand in code-point order, nulls last, and take ``weights`` in turn. With sources ordered by
    cap / weight, those before some point stand at their caps and the rest share what is left by weight; the
    point is the first at which the share fits under the next cap. The table has one row per source."""
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    cap = F.col("source_size") * max_repeats
    s = sizes.select("source", "source_size", F.element_at(F.lit(list(weights)), (turn + 1).cast("int")).cast("double").alias("weight")).withColumn("cap", cap.cast("double"))
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    s = (
        s.withColumn("caps_before", F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(order.rowsBetween(W.currentRow, W.unboundedFollowing)))
        .withColumn("total", F.sum("source_size").over(W.partitionBy()).cast("double"))
        .withColumn("level", (F.col("total") - F.col("caps_before")) / F.col("weight_left"))
        .withColumn("fits", F.col("level") <= F.col("cap") / F.col("weight"))
        .withColumn("share", F.min(F.when(F.col("fits"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(W.partitionBy())["level"])
    )
    return s.select("source", "source_size", "weight", F.when(F.col("fits"), F.least(F.col("share") * F.col("weight"), F.col("cap"))).otherwise(F.col("cap")).alias("target"))


def running_words(sized: DataFrame) -> DataFrame:
    """(source, key, size, n, upto): the documents of each key, their number, and the words of the source up to and
    with them, in order of keys.

    ``sized`` has source, size, key; it is read a few times and should be settled."""
    bits = (sized.count() // BUCKET_ROWS).bit_length()
    coarse = max(0, bits - GROUP_BITS)
    rows = sized.where("size > 0").groupBy("source", "key", "size").agg(F.count("*").alias("n"))
    rows = settle(rows.withColumn("bucket", F.shiftright("key", KEY_BITS - bits)))
    words = F.sum(F.col("size") * F.col("n"))
    buckets = rows.groupBy("source", "bucket").agg(words.alias("words")).withColumn("group", F.shiftright("bucket", bits - coarse))
    groups = buckets.groupBy("source", "group").agg(F.sum("words").alias("words"))
    before = lambda *by: F.sum("words").over(W.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("words")
    groups = groups.select(F.col("source").alias("g_source"), F.col("group").alias("g_group"), before("source", "group").alias("g_before"))
    buckets = buckets.withColumn("before", before("source", "group", "bucket"))
    buckets = buckets.join(groups, F.col("source").eqNullSafe(F.col("g_source")) & (F.col("group") == F.col("g_group")))
    buckets = buckets.select(F.col("source").alias("b_source"), F.col("bucket").alias("b_bucket"), (F.col("before") + F.col("g_before")).alias("before"))
    inside = words.over(W.partitionBy("source", "bucket").orderBy("key", "size").rowsBetween(W.unboundedPreceding, W.currentRow))
    rows = rows.withColumn("inside", inside).join(buckets, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("bucket") == F.col("b_bucket")))
    return rows.select("source", "key", "size", "n", (F.col("before") + F.col("inside")).alias("upto"))


def mix_stream(sized: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3) -> tuple[DataFrame, DataFrame]:
    """The stream of the mix and its sources.

    Stream: a row per key and pass (source, key, size, pass from 0, ``finish`` in virtual time, ``words`` taken from
    each document of the key), cut at the total budget (``cut_at_budget``). Sources: source,
    source_size, target. ``sized`` has source, size, key and should be settled."""
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = settle(source_targets(sizes, weights=weights, max_repeats=max_repeats).select("source", "source_size", "target"))
    budget = F.ceil(F.col("target") - ROUNDING).cast("long").alias("budget")
    s = sources.select(F.col("source").alias("t_source"), "source_size", "target", budget)
    s = F.broadcast(s) if sources.count() <= BROADCAST_SOURCES else s
    rows = running_words(sized).join(s, F.col("source").eqNullSafe(F.col("t_source")))
    served = (F.col("pass") * F.col("source_size") + F.col("upto")).alias("served")
    rows = rows.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1)))).select("*", served)
    # Words of each document of the key that are served up to virtual time 1.
    left = F.floor((F.col("budget") - F.col("served")) / F.col("n") + F.col("size")).cast("long")
    words = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), left))
    finish = F.when(F.col("served") >= F.col("budget"), F.lit(1.0)).otherwise(F.col("served") / F.col("target"))
    stream = rows.select("source", "key", "size", "pass", "n", finish.alias("finish"), words.alias("words")).where("words > 0")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    return cut_at_budget(stream, total), sources


def cut_at_budget(stream: DataFrame, total: int) -> DataFrame:
    """The rows of ``stream`` up to ``total`` words in order of finish time (ties by key, pass, size and source); the
    last row is taken in part.

    Only sums per range partition meet in one task, and rows of the one partition in which the budget ends."""
    ranged = settle(stream.repartitionByRange(*STREAM_ORDER).sortWithinPartitions(*STREAM_ORDER).withColumn("part", F.spark_partition_id()))
    row_words = F.col("words") * F.col("n")
    parts = ranged.groupBy("part").agg(F.sum(row_words).alias("part_words"))
    parts = parts.withColumn("before", F.sum("part_words").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("part_words"))
    rows = ranged.join(F.broadcast(parts), "part")
    inside = F.sum(row_words).over(W.partitionBy("part").orderBy(*STREAM_ORDER).rowsBetween(W.unboundedPreceding, W.currentRow)) - row_words
    left = F.lit(total) - F.col("before") - F.col("inside")
    ends = F.col("before") + F.col("part_words")
    tail = rows.where((F.col("before") < total) & (ends > total)).withColumn("inside", inside)
    tail = tail.withColumn("words", F.least("words", F.floor(left / F.col("n")).cast("long"))).where("words > 0").drop("inside")
    return rows.where(ends <= total).unionByName(tail).drop("part", "part_words", "before", "n")


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """Words of each document that the mix takes: doc_id, source, size, source_size, target, ``taken``."""
    sized = _sized(docs, id_col, text_col, source_col)
    stream, sources = mix_stream(sized.select("source", "size", "key"), weights=weights, max_repeats=max_repeats)
    taken = stream.groupBy(F.col("source").alias("k_source"), F.col("key").alias("k_key"), F.col("size").alias("k_size")).agg(F.sum("words").alias("taken"))
    s = sources.select(F.col("source").alias("p_source"), "source_size", "target")
    s = F.broadcast(s) if s.count() <= BROADCAST_SOURCES else s
    rows = sized.join(s, F.col("source").eqNullSafe(F.col("p_source")), "left")
    rows = rows.join(taken, F.col("source").eqNullSafe(F.col("k_source")) & (F.col("key") == F.col("k_key")) & (F.col("size") == F.col("k_size")), "left")
    return rows.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))


def mix_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """``docs`` as the mix serves them: a row per document and pass in global order of finish times, with mix_pass
    (from 0), mix_finish, mix_size, mix_taken (words taken in the pass) and mix_key.

    The stream's rows of a document are joined to it before the sort, so texts are moved once."""
    sized = _sized(docs, id_col, text_col, source_col)
    stream, _ = mix_stream(sized.select("source", "size", "key"), weights=weights, max_repeats=max_repeats)
    new = ("mix_pass", "mix_finish", "mix_size", "mix_taken", "mix_key")
    kept = [c for c in docs.columns if c not in new]
    own = [F.col(f"`{c}`").alias(f"o_{i}") for i, c in enumerate(kept)]
    size = word_count(F.col(text_col))
    rows = docs.select(*own, F.col(source_col).alias("m_source"), size.alias("mix_size"), shuffle_key(F.col(id_col), size).alias("mix_key")).where("mix_size > 0")
    rows = rows.join(stream, F.col("m_source").eqNullSafe(F.col("source")) & (F.col("mix_key") == F.col("key")) & (F.col("mix_size") == F.col("size")))
    rows = rows.select(*(F.col(f"o_{i}").alias(c) for i, c in enumerate(kept)), F.col("pass").alias("mix_pass"), F.col("finish").alias("mix_finish"), "mix_size", F.col("words").alias("mix_taken"), "mix_key")
    return rows.orderBy("mix_finish", "mix_key", "mix_pass")


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    size = word_count(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"))
    return settle(rows.withColumn("key", shuffle_key(F.col("doc_id"), F.col("size"))))
