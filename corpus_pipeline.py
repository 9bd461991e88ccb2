"""From raw documents to packed training sequences: each stage works on all that the one before it kept.

Language ID drops documents without an identifiable language; line dedup takes repeated lines out of texts; MinHash
near-dedup keeps one document of each group; benchmark decontamination drops documents that hold a benchmark item; packing
lays the tokens of what is left into windows.

Defined results: documents without text, or with a text that has no letter, go in the first stage, as their language can't be told;
line dedup leaves a text that loses all its lines as an empty document, near-dedup takes these for copies of each other and keeps the first,
and packing gives it one piece with its end alone. Documents without
an id stay: line dedup leaves their lines, near-dedup keeps them unless they are like a document with an id, decontamination looks at documents
with an id only. Of rows that repeat an id and a text one stays. Ties go to the least id. Empty tables pass through all stages. Columns of any
name are carried along up to packing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontamination, language_id, line_dedup, near_dup, packing
from tidemark.llm.common import cut_table, read
from tidemark.llm.queries import tokenizer

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.stage(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.stage(docs, one_blank=True)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.stage(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.digest(docs, tokenizer(), tokenizer("byte_bpe_50k.tiktoken"))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: Sketch verification, classification and tokenization aren't SQL; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; what a stage keeps is written as Parquet to the shared folder and read by the next."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
