"""A training corpus from documents: five stages, each written as Parquet and read again by the next.

No stage makes a decision for rows it has not read, none works on less than its predecessor
kept, and all but the last give back the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partlens.llm import jaccard, lines, packing, quality, suffixes
from partlens.llm.tables import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that fail the base rules or lie outside the fences of their language and source."""
    return quality.filter_documents(docs)


def _with_words(docs: DataFrame) -> DataFrame:
    """Without documents of which a stage has left nothing; quality rules let none in that had no words before."""
    return docs.where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later copies of repeated runs of lines; documents that consist of them go."""
    return _with_words(lines.dedup_lines(docs))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard of 0.8 or more on five-word shingles, the one with the smallest doc_id stays."""
    return jaccard.one_of_each(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes strings of 250 bytes that occur more than once: passages of over 50 words, whatever their letters."""
    return _with_words(suffixes.cut_documents(docs, span=suffixes.PASSAGE, gram=suffixes.PASSAGE_GRAM))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences of at most 2,048: one row per piece."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("suffix_array_dedup", suffix_array_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: The tokenizer's ids cannot be had in SQL; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
