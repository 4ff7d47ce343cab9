"""A training corpus from raw documents: classify, apply rules, drop near copies, cut repeats, pack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftlens.llm import ngram_join, packing, quality, quality_rules, suffix_dedup
from driftlens.llm._store import discard, materialize
from driftlens.llm.queries import tokenizer_file


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.keep_good(docs, _labels(spark, sf_dir))


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules and their model."""
    return quality_rules.keep_good(docs, _labels(spark, sf_dir))


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8."""
    return ngram_join.keep_one(docs, size=5, percent=80)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document holds."""
    return suffix_dedup.deduplicate(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents with their training sequences."""
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_stage),
    ("quality rules", rules_stage),
    ("near copies", near_copies_stage),
    ("repeated passages", repeats_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the trained stages nor the packing. Tests hold near copies and repeats against brute force and
#: the classifiers against the verdicts of op2 and op4, and the pieces of run() against the library on what the stages keep.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each to the written result of the one before."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        docs, path = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(spark, *before)
        before = [path]
    return STAGES[-1][1](spark, docs, sf_dir)
