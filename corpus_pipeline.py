"""A corpus pipeline of five stages; each stage's rows are written to the shared folder and read again by the next.

Every stage keeps the columns of documents, whatever other columns there are, and takes texts whole. Nulls: a null text has no
letter, so ``language_id`` drops it; a null doc_id, lang, source or n_chars is kept. Repeated rows are judged alike:
the first three stages keep or drop them together, and rows equal in doc_id and text are one document to the next two,
of which both stay. An empty table goes through all stages and packs into nothing.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripwire.llm import language, lines, links, packing, partenum, quality


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null, empty, digits only), or that no learned language codes better than uniform bytes, go.

    Where nothing can be learned (an empty table, no lang) no language codes anything, so all go.
    """
    return language.accepted(docs)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or diverge from every language's reference go; without a lang the base rules decide alone."""
    return quality.accepted(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that copy an earlier one go, and so do documents that this leaves with nothing but white space; n_chars follows the text.

    A null or blank text has no lines to lose and stays. Ties between equal lines: the first by (doc_id, line) stays.
    """
    out = lines.dedup(docs, short=True)
    kept = out.filter((F.col("line_dedup.n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents similar on five-word shingles (0.8 or more), one stays: the first by (doc_id, text hash).

    Documents without a word are similar to none and stay.
    """
    return partenum.one_of_each(docs, words=5, percent=80)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces in sequences of at most 1024 tokens; a null or empty text is its end token."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("best_fit_packing", best_fit_packing),
]

#: SQL expresses neither the language model nor the packing.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *stages, (_, last) = STAGES
    with links.Scratch(spark) as tmp:
        for _, stage in stages:
            before, docs = docs, tmp.stored(stage(spark, docs, sf_dir))
            tmp.drop(before)
        return links.stored(last(spark, docs, sf_dir))
