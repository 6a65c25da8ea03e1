"""A training-corpus pipeline out of five of the text operators; every stage works on what the last one kept.

Defined results, at every stage: documents with a null or empty text have no letters, so the first stage rejects them;
null ids are kept and stand last among equals, a null source is a source of its own, a null language is not learned
from; repeated rows count once from ``near_dedup`` on; texts are worked on whole, however long; columns other than
those of documents are dropped at the start, so their names can't clash; an empty table gives no rows, and one without
labels neither, as no language can be told."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axonframe.llm import decontaminate, langid, mixing, secrets, simhash
from axonframe.llm.common import settle, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID learned from the stage's own labels; documents it rejects go (no letters, or below the
    calibrated threshold)."""
    docs = docs.select(*COLUMNS)
    model = langid.fit_language_model(docs)
    return langid.predict_language(docs, model).where(~F.col("lang_rejected")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the smallest id. Documents are near-duplicates at a
    similarity of 0.8 of their 5-word shingles."""
    return simhash.first_of_groups(docs.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go."""
    found = decontaminate.find_leaks(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return found.where(F.size("leaks") == 0).select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark; no document goes."""
    found = secrets.scan_secrets(docs.select(*COLUMNS), secrets.vocabulary_ranks())
    return found.select("doc_id", F.col("secret_redacted").alias("text"), "lang", "source", F.when(F.size("secret_spans") > 0, F.length("secret_redacted").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which the mix takes words, with their number, once for each pass that does, in the order in which
    the mix serves them."""
    return mixing.mix_documents(docs.select(*COLUMNS))


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("mix", mix),
]

#: The stages learn, align and segment, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each settled before the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
