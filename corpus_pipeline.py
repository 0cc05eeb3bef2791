"""From raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on every row of ``docs`` and
returns a DataFrame, which a run writes as Parquet and reads again for the next
stage. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from declarium.llm import exact_dedup, mixing, packing, quality
from declarium.llm import near_dedup as near_dedup_by
from declarium.llm.queries import tokenizer_path
from declarium.llm.shared import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the lines over their host's
    limit; n_chars follows the text."""
    kept = quality.apply(docs)
    return kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    return exact_dedup.deduplicate(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id:
    texts link by op3's contract (shingles of three words, at most 3 of 64 bits), or
    if their five-word shingles have a similarity of 0.8 or more."""
    return near_dedup_by.apply(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix of sources takes it."""
    return mixing.apply(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 4096 tokens."""
    return packing.apply(docs, tokenizer_path()).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup_stage),
    ("simhash_near_dedup", near_dedup),
    ("mixing", mix_sources),
    ("best_fit_packing", pack),
]

#: Tokenizing, fingerprints and rounding are beyond SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    out = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        out = written(stage(spark, out, sf_dir), name)
    return STAGES[-1][1](spark, out, sf_dir)
