"""The registered queries of this package, each over its whole table, and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import LOWER, UPPER, table

TOKENIZER = os.environ.get("QUIRELIGHT_SENTENCEPIECE", "/opt/tokenizers/piece_bpe_32k.model")



def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    return identify(table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), keep=[], passage=250, least_words=50)


def op5_sentencepiece(spark: SparkSession, sf_dir: str, model: str = TOKENIZER) -> DataFrame:
    from .sentencepiece_fst import encode_table, read_model

    return encode_table(table(spark, sf_dir, "documents"), read_model(model))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract_text

    return extract_text(table(spark, sf_dir, "pages"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_by_bytes

    return shard_by_bytes(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_groups

    return simhash_groups(table(spark, sf_dir, "documents"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_score import stupid_backoff

    return stupid_backoff(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2:3].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_exact_dedup": f"""
            WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS norm FROM documents)
            SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
                   doc_id = max(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
            FROM n WINDOW g AS (PARTITION BY norm)""",
    }
