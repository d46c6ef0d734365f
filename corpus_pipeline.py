"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next.

Every stage works on all rows its predecessor kept, and its decisions take effect.  All but the last return the
columns of documents.  What a stage does with nulls, empty texts, repeated rows and clashing columns is that of
its operator; equal rows are one group for the near-duplicate stage, so one of them stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabloom.llm.common import read, unpacked
from tabloom.llm.contamination import decontaminate
from tabloom.llm.near_duplicates import without_near_duplicates
from tabloom.llm.packing import pack_documents
from tabloom.llm.quality import quality_rules
from tabloom.llm.secrets import without_secrets
from tabloom.llm.sources import tokenizer_file
from tabloom.session import staged


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return unpacked(quality_rules(docs).filter("kept"), docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the least id."""
    return without_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = decontaminate(docs, read(spark, sf_dir, "benchmark"))
    return unpacked(found.filter("not contaminated"), docs.columns)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a placeholder for every secret."""
    return without_secrets(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents with their sequences."""
    return pack_documents(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_stage),
    ("near duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secret_stage),
    ("packing", packing_stage),
]

#: Packing and the robust estimates have no SQL form; tests/llm holds every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
