"""Documents to shards: language, near duplicates, benchmark passages, source weights, shards.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and returns the columns of documents; the last one adds each row's place. Null,
empty and repeated rows go through as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cartloom.llm import decontaminate, langid, mixing, near_dedup, sharding
from cartloom.llm.registry import prepare, read, written
from cartloom.runtime import scratch_folder

SEED = 20240607
"""Of the shuffle over shards."""


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; those without text or letters go."""
    prepare(spark)
    return langid.identify(docs, langid.learned(docs)).filter(f"lang_pred <> '{langid.UNKNOWN}'").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8."""
    prepare(spark)
    return near_dedup.deduplicated(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words are benchmark passages."""
    prepare(spark)
    return decontaminate.decontaminated(docs, read(spark, sf_dir, "benchmark"))


def source_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that sources weigh the square root of their bytes, shuffled."""
    prepare(spark)
    return mixing.replicate(docs, mixing.source_rates(docs)).select(*docs.columns)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and its place there, shuffled over all; copies of a row are apart."""
    prepare(spark)
    return sharding.shard_documents(docs, sharding.SlotMap(spark, scratch_folder(spark)), seed=SEED)


STAGES = [
    ("language ID", language_id),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", benchmark_passages),
    ("mixing sources", source_weights),
    ("sharding", shards),
]

# Code lengths of byte contexts and signatures have no counterpart in SQL; the
# tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents, each one's rows written and read back."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
