"""Token ids as ORC files: integer run-length encoding, row indexes, and Bloom filters on document ids.

Documents are dealt by ranges of their ids and sorted in each file, so files, stripes and row groups hold disjoint ranges of
ids. A reader takes stripes in parallel, and a search for an id skips whatever the ranges and Bloom filters rule out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.llm.common import bytes_of, fresh, text_slices
from tessera.llm.word_ids import DEFAULT_VOCABULARY, END_ID, MEMO, word_encoder

OPTIONS = {"compression": "lz4", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": "1000", "orc.stripe.size": str(16 << 20)}
#: Rows of a file at most, about.
ROWS_PER_FILE = 50_000
#: part: the file's place in the order of ids; part_start: ids in the file before the document.
SCHEMA = "doc_id long, part int, part_start long, n_tokens long, ids array<int>"


def write_ids(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY, end_id: int = END_ID, options: dict[str, str] | None = None) -> None:
    """Writes doc_id, n_tokens, ids (with the end id) in ascending id order across files and in each.

    The texts are dealt by id once, before they are encoded, so drawing the ranges' bounds does not encode them; there are as many files as Spark's shuffle
    partitions, or one per ROWS_PER_FILE rows if that is more. A null text counts as empty (the end id alone), a null id comes first, rows that share an id
    follow each other by a hash of their texts, and may lie in several files; an empty table gives files without rows; other columns of ``df`` are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh(word_encoder)
        encoder, part, before = word_encoder(vocabulary), TaskContext.get().partitionId(), 0
        encoder.memo.limit = MEMO
        for batch in text_slices(batches, 1):
            flat, ends = encoder.encode_flat(bytes_of(batch.column(1)), end_id)
            ends = np.append(0, ends)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(before + ends[:-1]), pa.array(np.diff(ends), pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int32)))], ["doc_id", "part", "part_start", "n_tokens", "ids"])
            before += int(ends[-1])

    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // ROWS_PER_FILE))
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("order", F.xxhash64("text"))
    dealt = docs.repartitionByRange(parts, "doc_id", "order").sortWithinPartitions("doc_id", "order")
    dealt.select("doc_id", "text").mapInArrow(run, SCHEMA).write.options(**OPTIONS | (options or {})).orc(path)


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The files' own columns (SCHEMA)."""
    return spark.read.schema(SCHEMA).orc(path)


def with_starts(rows: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """Replaces part and part_start by start, the ids of all documents before.

    A file's own start comes from one row per file; that table has as many rows as there are files and is broadcast if Spark finds it small.
    """
    totals = stored(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = rows.join(totals.select("part", before.alias("before")), "part")
    return joined.select("doc_id", (F.col("before") + F.col("part_start")).alias("start"), *(c for c in rows.columns if c not in ("doc_id", "part", "part_start")))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids, from the files alone."""
    return with_starts(stored(spark, path), spark, path)


def checksums(files: DataFrame) -> DataFrame:
    """Replaces the ids by ids_crc32, the CRC of them as little-endian unsigned 32-bit integers. Narrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(kept))
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(crc, pa.int64())], [*kept, "ids_crc32"])

    kept = [c for c in files.columns if c != "ids"]
    schema = StructType(files.select(*kept).schema.fields[:]).add("ids_crc32", "long")
    return files.select(*kept, "ids").mapInArrow(run, schema)


def id_checksums(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of all documents in the files."""
    return with_starts(checksums(stored(spark, path)), spark, path)
