"""The corpus pipeline: documents to packed sequences, each stage one operator of ``codelens.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelens.llm import host_rules, line_dedup, mixing, packing, queries, simhash
from codelens.llm.text import aside
from codelens.scratch import materialise
from codelens.workers import reach


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the host-level rules keep."""
    own, given = aside(docs, host_rules.ADDED)
    return host_rules.judge(own).where("kept").select(*given)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the multi-line chunks that an earlier one holds."""
    own, given = aside(docs, line_dedup.ADDED)
    out = line_dedup.dedup_line_chunks(own)
    return (out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out).select(*given)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component."""
    reach(spark)
    return simhash.first_of_each(docs).select(*docs.columns)


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of tokens."""
    reach(spark)
    return packing.pack(docs, queries.tokenizer("word_bpe_49k.json"))


STAGES = [("quality rules", quality), ("line dedup", lines), ("near-dedup", near_copies), ("mixing", mixing_weights), ("packing", packed)]

#: Packing asks a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, f"stage{i}")
    return docs
