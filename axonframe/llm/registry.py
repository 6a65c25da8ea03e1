"""Queries of the text operators, one per operator with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, divergence, html_extract, langid, license_scan, lm_score, merkle, mixing, quality, secrets, simhash, url_filter, weighted_minhash
from .common import table
from .oracle import ORACLE_SQL

#: Rules of the URL query (action, host, path); longer ones win.
URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("block", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and test item that leaked into it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("x")).select("doc_id", "x.*")


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", lm_score.held_out(F.col("doc_id")).alias("held_out"))
    model = lm_score.fit(docs.where(~F.col("held_out")))
    return lm_score.score_texts(docs, model, id_cols=["doc_id", "held_out"])


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.quality_rules(table(spark, sf_dir, "documents"))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & F.col("good")).alias("kept"), F.array_join("failed", ",").alias("failed_rules")
    )


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (langid.remainder(F.col("doc_id"), 4) == 2).alias("held_out"))
    model = langid.fit_language_model(docs.where(~F.col("held_out")))
    return langid.predict_language(docs, model).select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"), "lang_rejected")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.extract_pages(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(spark, table(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(table(spark, sf_dir, "documents"), secrets.vocabulary_ranks())


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, url_filter.RULE_SCHEMA)
    rows = url_filter.url_filter(spark, table(spark, sf_dir, "pages"), rules)
    return rows.select("page_id", "host", "path", "rule", F.coalesce("action", F.lit("allow")).alias("verdict"))


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = weighted_minhash.fingerprint_texts(table(spark, sf_dir, "documents"))
    text = lambda c: F.lower(F.hex(c)).alias(c)
    return rows.select("doc_id", "n_chars", "edited_sha256", text("fingerprint"), text("edited_fingerprint"), "near_edited", "near_next")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"), tampered=F.crc32(F.col("doc_id").cast("string")) % 3 == 0)


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_simhash, op2_decontaminate, op3_lm_score, op4_quality, op5_langid, op6_mixing, op7_html, op8_licenses, op9_secrets, op10_url_filter, op11_fingerprints, op12_merkle, op13_divergence]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
