"""The corpus pipeline: quality rules, exact dedup, near-dedup, sanitisation, packing.

Each stage takes (spark, docs, sf_dir) and works on everything its predecessor kept; all but the last return the columns
of documents. Between stages the rows are a Parquet table in the shared folder, which goes once the next one stands.

Defined results: nulls in any column, empty and very long texts, ties and repeated rows have the results that the stages'
operators state; null and empty texts fail the quality rules, so they go first; an empty table gives no pieces; columns
besides doc_id and text pass through to the last stage whatever their names, and may be missing.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.llm import exact_dedup, near_dedup, packing, pii, quality
from docflow.llm.shared import discard, is_table, materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs, [public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")])


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(docs, keep="largest")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.deduplicate(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cleaned, length = pii.sanitise(docs, each_copy=True), F.length("text")
    if "n_chars" not in docs.columns:
        return cleaned
    return cleaned.withColumn("n_chars", F.when(length != F.col("n_chars"), length.cast("long")).otherwise(F.col("n_chars")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    special = packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, special=special)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_duplicates),
    ("minhash near-dedup", near_duplicates),
    ("pii", personal_data),
    ("packing", packed),
]

#: The token ids of the last stage are not expressible in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = docs if is_table(docs) else materialize(docs, f"pipeline-{number}")
            if before is not None:
                discard(before)
            before = docs
    return docs
