"""A corpus pipeline: rules, near duplicates, benchmark passages, personal data, packing.

Every stage works on all rows of its predecessor. Defined cases, for all five: a null text
counts as an empty one and stays null where its row stays; very long texts are worked
whole; equal rows, and rows with a null or repeated doc_id, are rows of their own unless a
stage says otherwise; an empty table gives an empty one; columns beyond those of documents
pass through, whatever their names, but in the last stage, which returns pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnfield.llm import decontaminate, packing, pii, quality_rules, simhash
from tarnfield.llm.common import drop_scratch, settled, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go.

    Null and empty texts go, having no words; equal texts share one verdict; without
    labelled rows the plain rules decide alone; a score that ties with a threshold keeps.
    """
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the least doc_id.

    Null and empty texts form one group; null ids lose against numbers; ties within an id
    go to the text of least hash, and of equal rows one stays.
    """
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go.

    Null and empty texts hold none and stay; items without an id count; without items, or
    with items that have no words, all documents stay.
    """
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to marks; every row stays.

    Null and empty texts stay as they are; where spans of two kinds overlap, the kind
    listed first is replaced; n_chars follows a changed text.
    """
    return pii.redact_pii(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in sequences of power-of-two lengths, one row for each piece.

    A null or empty text is one piece of the end id alone; pieces of equal length are
    numbered in the order in which the documents are read.
    """
    return packing.pack(docs)


STAGES = [("quality_rules", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("pii", personal_data), ("packing", pack)]
#: The forest of the first stage has no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written as Parquet and read again; what a stage read or needed goes when the next is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        last, docs = docs, settled(spark, lambda docs=docs, stage=stage: stage(spark, docs, sf_dir), name)
        if last is not docs and hasattr(last, "_scratch"):
            drop_scratch(last)
    kept = STAGES[-1][1](spark, docs, sf_dir)
    drop_scratch(docs)
    return kept
