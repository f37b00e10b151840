"""What the operators of this subpackage share: reading tables, shared storage, text batches."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that a Python worker handles at once; a longer text is a slice of its own.
SLICE_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder. Where the package is not installed, executors on this machine find it beside the driver's."""
    known = spark.sparkContext.environment
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    if root not in known.get("PYTHONPATH", "").split(os.pathsep):
        known["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known.get("PYTHONPATH", "")]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder that driver and executors share.

    It lies in the folder that the cluster names in ``spark.checkpoint.dir``. Only a local session without one (a test) gets a temporary folder.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/tessera-{uuid.uuid4().hex}"


#: With this set, the files of a query's shuffles go when the query ends; else they stay until the driver happens to collect its garbage.
SHUFFLES_END = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def durable(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read again: lineage ends there, on storage that outlives executors."""
    spark, path = df.sparkSession, path or shared_dir(df.sparkSession)
    before = spark.conf.get(SHUFFLES_END, "false")
    spark.conf.set(SHUFFLES_END, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLES_END, before)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Intermediate tables in the shared folder, dropped when their readers are done."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame) -> DataFrame:
        path = shared_dir(self.spark)
        out = durable(df, path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for table in tables:
            _, path = self.paths.pop(id(table), (None, None))
            if path:
                place = jvm.org.apache.hadoop.fs.Path(path)
                place.getFileSystem(conf).delete(place, True)

    def drop_all_but(self, *tables: DataFrame) -> None:
        kept = set(map(id, tables))
        self.drop(*(t for k, (t, _) in list(self.paths.items()) if k not in kept))


#: Functions whose results a worker keeps: models, and what was worked out with them.
KEPT: list[Callable] = []


def kept(make: Callable) -> Callable:
    """As functools.cache, and known to fresh()."""
    cached = functools.cache(make)
    KEPT.append(cached)
    return cached


def fresh(*needed: Callable) -> None:
    """A worker serves one operator after another: what it keeps for others than the needed ones goes, and freed memory goes back to the system."""
    for f in KEPT:
        if f not in needed and f.cache_info().currsize:
            f.cache_clear()
            gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where there is no glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def text_slices(batches: Iterator[pa.RecordBatch], column: int, max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts record batches so that a slice's texts have ``max_bytes`` at most, or are one text."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + max_bytes, "right"))
            yield batch.slice(at, (to := max(to, at + 1)) - at)
            at = to


def texts_of(column: pa.Array) -> list[str]:
    """Null counts as empty."""
    return [x or "" for x in column.to_pylist()]


def bytes_of(column: pa.Array) -> list[bytes]:
    """UTF-8 of the texts; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()]


class Memo:
    """What a worker remembers by key: two generations of ``limit`` entries or so; the older one goes when the younger is full."""

    def __init__(self, limit: int):
        self.limit, self.now, self.old = limit, {}, {}

    def turn(self) -> None:
        if len(self.now) > self.limit:
            self.now, self.old = {}, self.now

    def missing(self, keys: set, turn: bool = True) -> list:
        """Those of the keys that must be worked out and put into ``now``; all others are in there after this. turn: whether the generations may change."""
        if turn:
            self.turn()
        new = keys.difference(self.now)
        again = {k: self.old[k] for k in new if k in self.old} if self.old else {}
        self.now.update(again)
        return list(new.difference(again))
