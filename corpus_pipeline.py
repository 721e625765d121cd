"""A training-data pipeline: language, exact copies, near copies, benchmark passages, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signaloom.llm import decontaminate, exact_dedup, language_id, near_dedup, packing
from signaloom.llm.common import free_name, read_table, remainder
from signaloom.llm.token_counts import text_lengths
from signaloom.session import fresh_path

#: A text whose best language has a smaller posterior than this is rejected; that is about texts between languages, for the
#: posterior of any longer text is near 1, and texts of no language are rejected by their fit.
LEAST_SCORE = 0.4


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter and texts that no language fits; learns as the language query does."""
    labelled = docs.filter(remainder(docs["doc_id"], 5) != 0)
    model = language_id.fit_language_model(
        labelled, least_quantile=language_id.LEAST_QUANTILE, id_column="doc_id"
    )
    name = free_name(docs, "found")
    scored = docs.withColumn(name, language_id.language_of(spark, model, docs["text"]))
    known = (F.col(f"{name}.lang_pred") != language_id.UNKNOWN) & (F.col(f"{name}.score") >= LEAST_SCORE)
    return scored.filter(known & F.col(f"{name}.fits")).drop(name)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_duplicates(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_duplicates(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each text lies: one row per piece."""
    return packing.pack(text_lengths(docs), "doc_id", "n_tokens")


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

#: Learned models and token counts cannot be written in SQL; the tests hold every stage against plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; between stages the documents are written to the shared folder."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
