"""The registered queries: each applies its operator to a whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    conversations,
    decontamination,
    language,
    language_model,
    minhash,
    packing,
    phrases,
    quality,
    rules,
    sharding,
    suffix_array,
    suffix_tree,
    toxicity,
)
from .oracle import ORACLE_SQL  # noqa: F401
from .text import fold


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _held_out(parts: int, remainder: int) -> Column:
    return F.coalesce(fold(F.col("doc_id"), parts) == remainder, F.lit(False))


def learned(labels: DataFrame, parts: int, remainder: int) -> DataFrame:
    return labels.where(fold(F.col("doc_id"), parts) != remainder)


def op1_language(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    net = language.train(documents, learned(documents, 4, 2))
    return language.predict(documents, net).select("doc_id", _held_out(4, 2).alias("held_out"), "lang_pred", "score")


def op2_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = suffix_tree.remove_passages(table(spark, folder, "documents"), keep_text=False)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    net = quality.train(documents, learned(table(spark, folder, "labels"), 3, 1))
    return quality.score_documents(documents, net).select(
        "doc_id",
        _held_out(3, 1).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pack_powers_of_two(table(spark, folder, "documents"), tokenizer_path())
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket"
    )


def op5_minhash(spark: SparkSession, folder: str) -> DataFrame:
    marked = minhash.near_duplicates(table(spark, folder, "documents"))
    return marked.select("doc_id", "n_shingles", "component_id", "kept")


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    model = toxicity.train(documents, learned(table(spark, folder, "labels"), 3, 1))
    return toxicity.score_documents(documents, model).select(
        "doc_id",
        _held_out(3, 1).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


def op7_suffix_array(spark: SparkSession, folder: str) -> DataFrame:
    found = suffix_array.remove_repeats(table(spark, folder, "documents"), keep_text=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = rules.apply_policy(rules.ledger(table(spark, folder, "documents")))
    return judged.select(
        "doc_id",
        *("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"),
        (F.col("failed").bitwiseAND(F.lit(rules.mask("base"))) != 0).alias("base_failed"),
        "kept",
        F.col("failed").alias("failed_bits"),
    )


def op9_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    remainder = fold(F.col("doc_id"), 7)
    part = F.when(remainder == 2, language_model.SCORED).when(remainder == 3, language_model.WEIGHED)
    part = part.when(remainder.isNotNull(), language_model.COUNTED)
    return language_model.interpolated_scores(table(spark, folder, "documents"), part).select(
        "doc_id",
        _held_out(7, 2).alias("held_out"),
        "n_tokens",
        "n_known",
        "train_tokens",
        "base_score",
        "score",
    )


def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    leaks = decontamination.find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return leaks.select("doc_id", "item_id", "n_windows", "n_item", "reparameterised", "first_word")


def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    counted, words = phrases.frequent_phrases(table(spark, folder, "documents"), longest=3, least=10)
    return phrases.collocations(counted, words, top=2000)


def op12_sharding(spark: SparkSession, folder: str) -> DataFrame:
    dealt = sharding.shuffle_and_shard(table(spark, folder, "documents"), shards=24)
    return dealt.select(
        *("doc_id", "size", "text_crc32"),
        F.lit("rows").alias("law"),
        *("shard", "slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    rows = conversations.damaged(table(spark, folder, "conversations"))
    return conversations.repair(rows, lost="lost")


QUERIES = {
    "op1_language": op1_language,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_quality": op3_quality,
    "op4_packing": op4_packing,
    "op5_minhash": op5_minhash,
    "op6_toxicity": op6_toxicity,
    "op7_suffix_array": op7_suffix_array,
    "op8_quality_rules": op8_quality_rules,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_decontamination": op10_decontamination,
    "op11_collocations": op11_collocations,
    "op12_sharding": op12_sharding,
    "op13_conversation_repair": op13_conversation_repair,
}
