"""The corpus pipeline: quality rules, near duplicates, repeated passages, benchmark leaks, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glimmer.llm import chunks, decontamination, jaccard, packing, quality
from glimmer.llm.common import stored
from glimmer.llm.queries import tokenizer


# What all stages do with odd rows: null and empty texts fail the first stage's rules and go there; given to a later stage
# alone, they stay, as empty texts. Null ids are documents of their own that come last in every order; rows repeated whole
# are near duplicates of each other, of which one stays. Very long texts are taken whole. Empty tables give empty tables,
# and further columns come back as they are, whatever their names.


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that keep base rules and enough of their lines; lines that too many documents of a source have are cut out."""
    return quality.clean_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each class of texts linked by 0.8 of their 5-word sets."""
    return jaccard.without_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that stand in a document of smaller id, or earlier in their own; all documents stay."""
    return chunks.without_repeats(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no item of the benchmark table is found."""
    return decontamination.without_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents' ids with their sequences; what is left of an empty text is its end id."""
    return packing.pack(docs, tokenizer())


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("packing", sequence_packing),
]

#: Edit distances, content-defined chunks and token ids are not for SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage{k}")
    return docs
