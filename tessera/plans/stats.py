"""What ran, in which mode and for how long; and the history of statements by their text."""

from __future__ import annotations

import datetime
import threading
import time

from pyspark.sql import DataFrame, SparkSession

STATS = "sql string, execution_mode string, merge_strategy string, query_duration_ms bigint, num_workers_used bigint, num_tasks_generated bigint, execution_start_time timestamp_ntz"
HISTORY = "query string, latencies array<bigint>"


class Recorder:
    def __init__(self):
        self.lock = threading.Lock()
        self.executions: list[tuple] = []
        self.latencies: dict[str, list[int]] = {}

    def execution(self, sql: str, mode: str, merge: str, ms: int, workers: int, tasks: int, start: datetime.datetime) -> None:
        """workers: those that were available."""
        with self.lock:
            self.executions.append((sql, mode, merge, ms, workers, tasks, start))

    def statement(self, sql: str, ms: int) -> None:
        with self.lock:
            self.latencies.setdefault(sql, []).append(ms)

    def clear(self) -> bool:
        with self.lock:
            self.executions.clear()
            self.latencies.clear()
        return True

    def stats(self, spark: SparkSession) -> DataFrame:
        with self.lock:
            return spark.createDataFrame(list(self.executions), STATS)

    def history(self, spark: SparkSession) -> DataFrame:
        with self.lock:
            return spark.createDataFrame(sorted(self.latencies.items()), HISTORY)


class Clock:
    def __enter__(self) -> Clock:
        self.start, self.began = datetime.datetime.now(datetime.UTC).replace(tzinfo=None), time.perf_counter()
        return self

    def __exit__(self, *_) -> None:
        self.ms = round((time.perf_counter() - self.began) * 1000)
