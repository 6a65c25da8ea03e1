"""Divergence of sources inside a language: which sources of a language use its words unlike the others.

Method: regular-expression matches are exploded and counted per language, source and term; terms of enough documents of a
language are kept; the language's groups are crossed with its kept vocabulary, so that terms a source lacks count zero; the
dense table is joined with itself on language and term, differences are summed per pair of sources, and windows rank them.

Occurrences and documents are counted by the same aggregate, combined before the shuffle: every match is a row, and
every different term of a document another one. Counts meet by language and term, one row with a map of its sources, which is
the key of the self-join: both sides are this row, so the join is two explodes of it and moves nothing. Groups meet the
vocabulary by language and one of ``SALTS`` salts of the term, so that a hot language is spread. Probabilities are whole
numbers of billionths, by long or decimal arithmetic, so all is exact.

Defined results: null text, language and source are empty strings; a row counts as a document of its own, whatever its
id; a document without terms still makes its group occur; a language without kept terms gives pairs of value 0 and no
terms; ties go to the item that is first in UTF-8; columns other than text, lang and source are not read; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ascii_lower, settle

#: Fixed value: terms are runs of letters A-Z and of characters beyond ASCII.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: What stands between terms.
GAP = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents of a language that a kept term is in, ranks of terms reported, unit of probabilities.
MIN_DOCS = 3
TERM_RANKS = 200
SCALE = 1_000_000_000
SALTS = 32


def pieces(text: Column) -> Column:
    """All matches of ``TERM`` in a text, cut out by what stands between them; the first and last can be empty. Where a text
    is ASCII, ``lower`` changes A-Z alone."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.split(F.when(ascii_only, F.lower(text)).otherwise(ascii_lower(text)), GAP)


#: Counts whose scaled value fits a long.
LONG_COUNTS = (2**63 - 1) // SCALE - 1


def share(count: Column, total: Column, size: Column) -> Column:
    """1 + floor(SCALE (count + 1) / (total + size)), exact for any long counts."""
    whole = lambda c: c.cast("decimal(19,0)")
    exact = F.call_function("div", whole(count + 1) * F.lit(SCALE).cast("decimal(10,0)"), whole(total + size))
    return F.when(count < LONG_COUNTS, F.call_function("div", (count + 1) * F.lit(SCALE).cast("long"), total + size)).otherwise(exact) + 1


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of a group's terms."""
    clean = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    found = docs.select(clean("lang"), clean("source"), pieces(F.coalesce("text", F.lit(""))).alias("t"))
    # 0 beside each occurrence, 1 beside each different term of the document; plain explodes stay in generated code.
    both = found.select("lang", "source", F.posexplode(F.array("t", F.array_distinct("t"))).alias("k", "t"))
    rows = both.select("lang", "source", "k", F.explode("t").alias("term")).where("term != ''")
    return rows.groupBy("lang", "source", "term").agg(F.sum(1 - F.col("k")).alias("n"), F.sum("k").alias("docs"))


def source_divergence(docs: DataFrame, *, min_docs: int = MIN_DOCS, term_ranks: int = TERM_RANKS) -> DataFrame:
    """Rows (lang, source, part, item, value, rank).

    Part ``pair``: every other source of the language with the summed divergence of the group from it. Part ``term``: the
    terms that the group uses more than its language, by divergence."""
    by_source = F.map_from_entries(F.collect_list(F.struct("source", "n")))
    vocab = term_counts(docs).groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("docs").alias("docs"), by_source.alias("by_source"))
    vocab = settle(vocab.where(F.col("docs") >= min_docs).drop("docs"))
    clean = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    groups = docs.select(clean("lang"), clean("source")).distinct()
    totals = vocab.select("lang", F.explode("by_source").alias("source", "n")).groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = vocab.groupBy("lang").agg(F.sum("all_n").alias("all_total"), F.count("*").alias("v"))
    # A row per group, however many documents it has.
    groups = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = settle(groups.select(F.monotonically_increasing_id().alias("id"), "lang", "source", F.coalesce("total", F.lit(0)).alias("total"), "all_total", "v"))
    per_lang = groups.where("v IS NOT NULL").groupBy("lang").agg(F.max("all_total").alias("all_total"), F.max("v").alias("v"), F.collect_list(F.struct("id", "source", "total")).alias("groups"))
    salted = per_lang.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    met = vocab.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int")).join(salted, ["lang", "salt"])
    zero = F.lit(0).cast("long")

    def cell(g: Column) -> Column:
        n = F.coalesce(F.try_element_at("by_source", g["source"]), zero)
        return F.struct(g["id"].alias("id"), n.alias("n"), share(n, g["total"], F.col("v")).alias("p"))

    dense = met.select("term", share(F.col("all_n"), F.col("all_total"), F.col("v")).alias("q"), F.transform("groups", cell).alias("cells"))
    pairs = dense.select("cells", F.explode("cells").alias("a")).select("a", F.explode("cells").alias("b")).where("a.id != b.id")
    sums = pairs.groupBy(F.col("a.id").alias("s_id"), F.col("b.id").alias("s_item")).agg(F.sum(divergence(F.col("a.p"), F.col("b.p"))).alias("value"))
    item = groups.select(F.col("id").alias("i_id"), F.col("lang").alias("i_lang"), F.col("source").alias("item"))
    names = groups.join(item, (F.col("lang") == F.col("i_lang")) & (F.col("id") != F.col("i_id")))
    pairs = names.join(sums, (F.col("id") == F.col("s_id")) & (F.col("i_id") == F.col("s_item")), "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", zero).alias("value"))
    used = dense.select("term", "q", F.inline(F.filter("cells", lambda c: (c["n"] > 0) & (c["p"] > F.col("q")))))
    used = used.select("id", F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    place = lambda *by: F.row_number().over(W.partitionBy(*by).orderBy(F.desc("value"), "item")).alias("rank")
    used = used.select("*", place("id")).where(F.col("rank") <= term_ranks).join(groups, "id")
    return pairs.select("*", place("lang", "source")).unionByName(used.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))
