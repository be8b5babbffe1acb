"""A corpus pipeline out of five operators; each stage's rows are written and read again.

Null ids and texts pass every stage; what each operator does with them is in its
docstring. All stages but the last return the columns that they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyframe.llm import decontamination, minhash, packing, queries, suffix_tree, toxicity
from tallyframe.llm.shared import written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below 0.7; the model learns as that of op6 does."""
    model = toxicity.train(docs, queries.learned(queries.table(spark, sf_dir, "labels"), 3, 1))
    return toxicity.keep_clean(docs, model, 0.7)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id."""
    return minhash.keep_one(docs, minhash.near_duplicates(docs))


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words that start in one with a smaller id.

    Texts that lose nothing stay as they are, line ends included; of the others the kept
    words are joined by blanks. Documents of which nothing is left are dropped.
    """
    return suffix_tree.cut_passages(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    leaks = decontamination.find_leaks(docs, queries.table(spark, sf_dir, "benchmark"))
    return decontamination.drop_leaks(docs, leaks)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences whose lengths are powers of two, with their token ids.

    The Python workers also run the other stages, so they keep no words between tasks.
    """
    return packing.pack_powers_of_two(docs, queries.tokenizer_path(), keep_words=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", cut_passages),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: The learned model and the tokenizer have no SQL; the tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; the last stage's rows."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
