"""The corpus pipeline: toxicity, exact dedup, near dedup, source mixing, packing.

Each stage reads all that its predecessor kept, written as Parquet in the shared
folder and read again. All but the last return the columns of ``documents``. The last
returns a row per packed piece. Mixing keeps every document and reads the smaller
sources up to ``REPEATS`` times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recordloom.llm import mixing, near_dedup, packing, toxicity
from recordloom.llm.common import saved, table
from recordloom.llm.exact_dedup import drop_repeats
from recordloom.llm.queries import early_and_late, tokenizer_path

REPEATS = 1.5


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go; the model learns from the labels of the documents at hand."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays, the one with the smallest doc_id."""
    return drop_repeats(*early_and_late(docs))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays."""
    return near_dedup.drop_near_copies(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix reads it."""
    return mixing.mixed_documents(docs, repeats=REPEATS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece with its sequence and offset."""
    return packing.packed_pieces(docs, tokenizer_path(), end_id=0)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact dedup", exact_stage),
    ("near dedup", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]
ORACLE_SQL = None  # the stages learn models and tokenise; tests hold them against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
