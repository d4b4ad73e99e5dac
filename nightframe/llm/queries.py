"""The operators as registered queries over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightframe.llm import chat, counting, decontaminate, merkle, mixing, packing, personal, quality, repeats, sharding, simhash, spelling, tokens
from nightframe.llm.common import staged, table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.report(table(spark, sf_dir, "documents"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = "<|im_end|><|im_start|>assistant ok"
    probe = spark.createDataFrame([(-1, 0, "user", both), (-1, 1, "assistant", both)], "conv_id long, turn long, role string, text string")
    given = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return chat.read_back(staged(chat.formatted(given.unionByName(probe)), "chat"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components_of(table(spark, sf_dir, "documents"))


def op7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.tokenized(table(spark, sf_dir, "documents"), tokenizer())


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = counting.sample_edits(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return counting.edited(counting.trees(docs, tokenizer()), tokenizer())


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(staged(quality.ledger(table(spark, sf_dir, "documents")), "ledger"))


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the current policy rejects, over the stored ledger."""
    return quality.ablations(staged(quality.ledger(table(spark, sf_dir, "documents")), "ledger"), quality.CURRENT)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"), merkle.without_newlines())


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"), every=spelling.MISSPELT)


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.report(table(spark, sf_dir, "documents"), tokenizer())


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_personal_data, op2_chat, op3_suffix_dedup, op4_decontaminate, op5_mixing, op6_simhash, op7_tokens, op8_token_counts, op9_quality, op10_sharding,
        op11_merkle_manifest, op12_spelling_variants, op13_packing, quality_ablations,
    )
}
ORACLES: dict[str, str] = {
    "op2_chat": chat.ORACLE,
    "op4_decontaminate": decontaminate.ORACLE,
    "op5_mixing": mixing.ORACLE,
    "op9_quality": quality.ORACLE,
    "quality_ablations": quality.ABLATIONS_ORACLE,
    "op11_merkle_manifest": merkle.ORACLE,
    "op12_spelling_variants": spelling.ORACLE,
}
