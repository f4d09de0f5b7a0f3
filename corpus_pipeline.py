"""From raw documents to packed training sequences: five stages, each written as Parquet and read again as the next one's docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioforge.llm import exact_dedup, mixing, packing, quality, similar
from folioforge.llm.common import shared_dir
from folioforge.llm.queries import tokenizer


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality.keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the one with the largest doc_id."""
    return exact_dedup.drop_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts with a five-word Jaccard similarity of 0.8 or more, the document with the smallest doc_id."""
    return similar.drop_similar(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to the target weights of source, language and topic."""
    return mixing.sample(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, packed into sequences of 2048 tokens; one row for each piece."""
    return packing.digest(packing.pack(docs, tokenizer("word_bpe_49k.json"), 1))


STAGES = [("quality rules", quality_rules), ("exact dedup", exact), ("near dedup", near), ("mixing", mix), ("packing", pack)]

#: SQL has no near-duplicate components and no packing; tests/llm hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents, one after the other; an empty or odd table goes through as each operator says."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            folder = shared_dir(spark, f"pipeline-{k}")
            docs.write.parquet(folder)
            docs = spark.read.parquet(folder)
    return docs
