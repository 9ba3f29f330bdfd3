"""A corpus pipeline in five stages, each of which reads what the one before has written.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last give the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.llm.common import materialize
from lamella.llm.ngram_join import drop_near_duplicates
from lamella.llm.packing import WEIGHTS, pack
from lamella.llm.pii import redact_pii
from lamella.llm.quality import keep_good
from lamella.llm.repeats import remove_repeats


def _sized(docs: DataFrame) -> DataFrame:
    """``n_chars`` of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or are robust outliers of their language and source go."""
    return keep_good(docs)


def near_duplicate_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest id stays."""
    return drop_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document has are cut out; a document that loses all its words stays, empty."""
    return _sized(remove_repeats(docs).select(*docs.columns))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets."""
    return _sized(redact_pii(docs)).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048: one row a piece."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), weights=WEIGHTS)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicate_join", near_duplicate_join),
    ("substring_dedup", substring_dedup),
    ("pii", pii),
    ("best_fit_packing", best_fit_packing),
]

#: Robust estimates, automata and vocabularies are beyond SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"pipeline-{name}")
    return docs
