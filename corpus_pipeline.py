"""Corpus pipeline: quality rules, toxicity, near duplicates, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and works on everything that the one before kept. The first four return the
columns of ``documents`` (doc_id, text, lang, source, n_chars, and any others as they are); the last returns pieces.
Null, empty and repeated rows are treated as the stages' operators say; an empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfweek.llm import decontaminate, packing, quality_rules, simhash, toxicity
from shelfweek.llm.base import table
from shelfweek.session import materialise


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the quality rules reject; what stays goes on without the lines that fail."""
    judged = quality_rules.quality(docs).filter("quality.kept")
    out = {"text": F.col("quality.clean_text"), "n_chars": F.length("quality.clean_text").cast("long")}
    return judged.select(*(out[c].alias(c) if c in out else c for c in docs.columns))


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents at or above the toxicity threshold. The model never sees the held-out labels."""
    labels = table(spark, sf_dir, "labels").filter(~toxicity.held_out(F.col("doc_id")))
    scored = toxicity.with_toxicity(docs, toxicity.fit(docs, labels))
    return scored.filter(F.col("toxicity") < toxicity.THRESHOLD).select(*docs.columns)


def keep_first(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of fingerprints (three-word shingles, two or fewer differing bits) the smallest doc_id stays."""
    return simhash.first_of_each(docs, words=3)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a test item."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, packing.tokenizer_path())


STAGES = [
    ("quality_rules", keep_good),
    ("toxicity", keep_civil),
    ("near_duplicates", keep_first),
    ("decontamination", keep_clean),
    ("packing", pack),
]
#: Hashes, trained models and tokens have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return docs
