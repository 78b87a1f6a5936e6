"""A corpus pipeline: quality rules, line dedup, near-duplicate removal, benchmark decontamination, tokenizing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliograph.llm import bpe, decontaminate, linededup, minhash, quality_rules
from foliograph.llm.store import stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or that the label model of this input thinks bad go."""
    counted = stored(quality_rules.counts(docs), "quality-counts")
    return quality_rules.judge(counted, quality_rules.fit(counted)).where("kept").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; `n_chars` follows the text."""
    kept = linededup.dedup(docs)
    return kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with similar sets of five-word shingles (0.8 or more), directly or through others, one stays."""
    return minhash.dedup(docs, words=5, percent=80).select(*docs.columns)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item within 8 per cent of edits go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, checked by decoding: `round_trip` says whether the bytes came back."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    texts = docs.select("doc_id", "text", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("digest"))
    coded = bpe.decode(bpe.encode(texts, ranks, public_tokenizers.PATTERN, tasks=bpe.scan_tasks(texts), drop_text=True), ranks)
    return coded.select("doc_id", "ids", F.size("ids").cast("bigint").alias("n_tokens"), (F.sha2("decoded", 256) == F.col("digest")).alias("round_trip"))


STAGES = [("quality rules", quality), ("line dedup", lines), ("near duplicates", near), ("decontamination", leaks), ("byte-level BPE", tokens)]

#: The label model's iterations have no SQL form; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
