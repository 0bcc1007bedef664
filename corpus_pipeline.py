"""From documents to packed token ids in five stages, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandjoin.llm.common import materialise, table
from strandjoin.llm.decontaminate import decontaminate
from strandjoin.llm.mixing import mixed_documents
from strandjoin.llm.near_dup import near_dedup
from strandjoin.llm.packing import pack
from strandjoin.llm.quality import accepted


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or a risk-controlled cutoff rejects go.

    A null or empty text goes by the base rule. A null id or language is like any other (ids without a label, a
    language of its own). Rows that repeat are judged each by itself, long texts whole; other columns stay as they are.
    """
    return accepted(docs, table(spark, sf_dir, "labels"))


def near_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, 0.8) stays: that with the smallest id, or where ids are null or repeat the first row.

    Rows with equal texts are a group. Texts without words are linked with nothing and stay. Other columns stay as they are.
    """
    return near_dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark item go, whatever their ids; null and empty texts have none. Repeated rows share their fate; other columns stay as they are."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at their weights; a document has a row, whole and with all its columns, for each epoch that takes it.

    Null and empty texts have no words and are never taken. A null source is one of its own. Rows that repeat are documents each.
    """
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token ids. A null or empty text is the end-of-text id alone; long texts are split without loss; null ids stay null."""
    return pack(docs)


STAGES = [("quality_rules", quality), ("near_dup", near_dup), ("decontamination", decontamination), ("mixing", mixing), ("token_packing", packing)]

#: Packing and near-duplicates can't be expressed in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage_{name}")
    return docs
