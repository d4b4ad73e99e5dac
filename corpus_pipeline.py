"""The corpus pipeline: rules, near-duplicates, decontamination, mixing, token shards.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; ``run`` writes
every stage's rows as Parquet to the shared folder and rereads them for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from nightframe.llm import decontaminate, mixing, quality, simhash, tokens
from nightframe.llm.common import staged, table
from nightframe.llm.queries import tokenizer


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule of the current policy rejects go."""
    return quality.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that with the smallest id."""
    return simhash.keep_near(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark window occurs go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target takes it: not at all, once or twice."""
    return mixing.repeated(docs)


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards, written and read back: doc_id, start, n_tokens, ids_crc32."""
    return tokens.tokenized(docs, tokenizer())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("without_benchmark", without_benchmark),
    ("mixed_sources", mixed_sources),
    ("token_shards", token_shards),
]

#: SimHash and BPE have no SQL form; tests compare the stages with plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
