"""The corpus pipeline: five stages over ``documents``, each written as a table and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtide.llm import decontam, line_dedup, minhash, quality_rules, spm_dropout
from loomtide.llm.scratch import stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, and lines that are removed on their host go from the others; ``n_chars`` follows the text.

    Null and empty texts are rejected, repeated rows share a verdict, null ids and hosts are values of their own, and an empty table stays empty.
    """
    return quality_rules.keep_good_documents(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that several documents share stay in the first of them; ``n_chars`` follows the text.

    A null text becomes the empty one; rows with a null id are unchanged; repeated rows are one document.
    """
    cut = line_dedup.dedup_lines(docs).select(*docs.columns)
    return cut.withColumn("n_chars", F.char_length("text").cast("long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 0.8) stays.

    Rows without words or with a null id stay; repeated rows collapse to one.
    """
    return minhash.drop_near_duplicates(docs, width=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; rows with a null id or text stay, and an empty benchmark drops nothing."""
    return decontam.drop_leaking_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text, proved to decode to it; a null text is the empty one, which has no ids."""
    return spm_dropout.encode_documents(docs, dropout=0.1, seed=1).select("doc_id", "text", "ids", F.size("ids").cast("long").alias("n_tokens"))


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("near-duplicate removal", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding", encoding),
]

#: SQL can't express the SimHash and encoding stages; tests/llm/test_pipeline.py compares the run with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents`` and return the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
