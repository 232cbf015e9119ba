"""The queries of the training-data operators and the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.llm import licences


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docflow.llm import sharding

    return sharding.sharded(_documents(spark, sf_dir))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docflow.llm import bpe

    return bpe.round_trip(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(_documents(spark, sf_dir))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docflow.llm import pii

    return pii.spans_of(_documents(spark, sf_dir), each_copy=True)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docflow.llm import exact_dedup

    found = exact_dedup.resolve(_documents(spark, sf_dir), keep="largest")
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docflow.llm import packing

    return packing.pack(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, special=packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json")))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docflow.llm import lm_score

    return lm_score.scored(_documents(spark, sf_dir))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docflow.llm import quality

    return quality.measure(_documents(spark, sf_dir), [public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")])


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docflow.llm import near_dedup

    return near_dedup.grouped(_documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "kept")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docflow.llm import token_counts

    return token_counts.counted(_documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_bpe": op2_bpe,
    "op3_licences": op3_licences,
    "op4_pii": op4_pii,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_packing": op6_packing,
    "op7_lm_score": op7_lm_score,
    "op8_quality": op8_quality,
    "op9_minhash": op9_minhash,
    "op10_token_counts": op10_token_counts,
}

ORACLES: dict[str, str] = {
    "op3_licences": licences.oracle(),
    "op5_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC) AS k FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, k = 1 AS kept, sha256(t) AS text_sha256 FROM d""",
    "op9_minhash": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\t-\r]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b USING (shingle) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
        m AS (SELECT a, min(b) AS component_id FROM r GROUP BY 1)
        SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, w.doc_id = component_id AS kept FROM w LEFT JOIN n USING (doc_id) JOIN m ON m.a = w.doc_id""",
}
