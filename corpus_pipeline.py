"""The corpus pipeline: documents in, packed sequences out.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept and returns a DataFrame; run() writes each result as Parquet into the
folder that the cluster shares and reads it back for the next stage. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, language, ngram_join, packing, secrets
from tessera.llm.common import Scratch, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, and null ones; profiles come from the rows that are not held out. Without profiles all others stay as well.

    Repeated rows, null ids and rows that share an id are judged each by its own text.
    """
    profiles = language.fit(docs.where(~F.coalesce(language.held_out(), F.lit(False))))
    columns = [c for c in COLUMNS if c != "text"] + ["text"]
    if not profiles:
        return language.with_letter(docs, columns).select(*COLUMNS)
    told = language.identify(docs, profiles, columns=columns)
    return told.where(F.col("lang_pred") != language.UNKNOWN).select(*COLUMNS)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each text, the one with the largest id (nulls last); null counts as empty, repeated rows collapse."""
    return exact_dedup.drop_copies(docs.select(*COLUMNS), keep="largest")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of similar documents one row, the one with the smallest id (nulls last, ties by content); texts without a word all stay."""
    return ngram_join.keep_one(docs.select(*COLUMNS))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks credentials that look live (few owners and repositories hold them); keeps every row, each masked by its own text. n_chars follows the text."""
    return secrets.mask_secrets(docs.select(*COLUMNS), length_col="n_chars")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts documents into sequences of power-of-two lengths; an empty or null text is the end id alone, a null id stays null."""
    return packing.digests(packing.pack(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", identify_language),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("secret scans", mask_secrets),
    ("packing", pack),
]

#: SQL can express neither the profiles' distances nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages' last result over the whole table documents. An empty table gives no rows; columns beyond those of documents are not read."""
    docs, scratch, before = table(spark, sf_dir, "documents"), Scratch(spark), None
    for _, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir))
        scratch.drop(before)
        before = docs
    return docs
