"""A corpus pipeline of five stages over documents, each of which writes what the next one reads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshloom.llm import decontaminate, langid, mixing, neardup, pii
from meshloom.llm.common import fold, materialize, scratch, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one language: those without letters, and mixtures of which no language has half, go."""
    model = langid.fit(docs.filter(fold(F.col("doc_id"), 4) != 2))
    found = langid.identify(docs, model, spans=False)
    return found.filter(~langid.rejected(F.col("lang_pred"), F.col("lang_score"))).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return neardup.keep_one(docs).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without contamination by the benchmark."""
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.filter(~F.col("contaminated")).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; n_chars follows."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy of a document that the mix of sources takes, numbered by copy."""
    return mixing.emit(mixing.mix(docs)).select(*COLUMNS, "size", "source_size", "target", "taken", "copy")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [("language ID", language), ("near duplicates", near_duplicates), ("decontamination", decontamination), ("personal data", personal_data), ("mixing", mixture)]

#: Not expressible in SQL: language scores and fingerprints. A test checks on a small corpus which documents stay and what becomes of their texts; it does not hold every value against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        if i == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        with scratch(spark, keep=1):  # only what the stage returns outlives it
            docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
