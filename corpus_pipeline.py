"""The training-data pipeline: language ID, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.llm import decontaminate, lang_id, line_dedup, packing, simhash_forest
from chronofold.llm.common import materialise, prepare, table

#: A text whose likeliest language has a mean probability below this is no text in any learned language.
MIN_LANGUAGE_SCORE = 0.3
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language; those without a letter, or like none of the learned languages, go."""
    prepare(spark)
    found = lang_id.identify(docs.select(*COLUMNS))
    return found.where((F.col("lang_pred") != lang_id.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE)).select(*COLUMNS)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that at least three hold (the largest doc_id keeps its own)."""
    kept = line_dedup.dedup_lines(docs.select(*COLUMNS), keep_columns=True)
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return simhash_forest.keep_one(docs.select(*COLUMNS)).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items: those that are contaminated or hold a whole window go, shorter items are cut out."""
    kept = decontaminate.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return kept.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text")).otherwise(F.col("n_chars")).cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of 4096-token sequences."""
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup_stage), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", pack)]

#: SQL cannot express language ID, near-dedup and tokenization.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's result written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, f"pipeline-{name}")
    return docs
