"""From raw documents to packed training sequences, in four stages.

Each stage is (name, function of (spark, docs, sf_dir)); its result is written as Parquet and read again as the
next stage's ``docs``.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trawl.llm import jaccard, kneser_ney, packing, repeats
from trawl.llm._store import written


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return kneser_ney.kept(docs, labels)


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones."""
    return jaccard.deduplicate(docs)


def _repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has."""
    return repeats.remove(docs)


def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality classifier", _quality),
    ("n-gram jaccard join", _near_duplicates),
    ("substring dedup", _repeated_passages),
    ("packing", _packing),
]

#: A perplexity threshold is not expressible in SQL: tests/llm/test_brute_force.py checks run() by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packs of the last stage.  Nulls, empty and very long texts, ties and repeated rows, empty tables and extra
    columns have in each stage the result that its operator states: documents without words are rejected by the
    first stage, rows without doc_id pass the others as they are, a null language is one of its own, extra columns are
    carried up to the last stage, and an empty table gives no packs."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = []
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"), *before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
