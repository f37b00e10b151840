"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import exact_dedup, language, ngram_join, orc_ids, packing, piece_codec, secrets, suffix_dedup, tiff, token_counts
from tessera.llm.common import shared_dir, table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op2_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.digests(tiff.read_pages(tiff.write_media(table(spark, sf_dir, "documents")), ["doc_id", "n_bytes"]))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.digests(piece_codec.encode_pieces(table(spark, sf_dir, "documents")))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(packing.pack(table(spark, sf_dir, "documents")))


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.find_secrets(table(spark, sf_dir, "documents")))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_groups(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), keep="largest")


def op8_orc_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark) + "/ids.orc"
    orc_ids.write_ids(table(spark, sf_dir, "documents"), path)
    return orc_ids.id_checksums(spark, path)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predictions(table(spark, sf_dir, "documents"))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_counts, op2_tiff_pages, op3_sentencepiece, op4_packing, op5_secret_scans, op6_ngram_jaccard_join, op7_exact_dedup, op8_orc_ids, op9_language_id, op10_suffix_array_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op5_secret_scans": secrets.oracle(), "op7_exact_dedup": exact_dedup.ORACLE}
