"""A training-data pipeline over ``documents``: five stages, each an operator of ``karstflow.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's ``docs``; all but the last return the columns of documents. Nulls, empty
texts, repeated rows, empty tables and extra columns are handled as each operator's docstring says;
a document that a stage leaves without text stays, as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from karstflow.llm.common import settle, table
from karstflow.llm.decontaminate import clean_documents
from karstflow.llm.near_dedup import drop_near_copies
from karstflow.llm.sentence_pieces import with_pieces
from karstflow.llm.suffix_dedup import without_repeats
from karstflow.llm.toxicity import keep_clean


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain calls toxic go."""
    return keep_clean(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return drop_near_copies(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes or more that stand earlier already are cut from the texts."""
    return without_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def sentence_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each text's piece ids, and whether they decode to the text again."""
    rows, ids, whole = with_pieces(docs)
    return rows.withColumn("n_pieces", F.size(ids).cast("long"))


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("decontamination", decontamination),
    ("sentence_pieces", sentence_pieces),
]

#: A trained classifier and a tokenizer are no SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
