"""Sessions: a configured SparkSession, and descriptors of workers and drivers.

Spark owns executors and their life; the descriptors only answer the control functions (start, stop, register, count).
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import SparkSession

DEFAULT_PORT = 8815
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
#: What any session of this engine needs; sizes of partitions are left to the cluster's own settings.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build(master: str | None = None, name: str = "tessera", **settings: str) -> SparkSession:
    """A SparkSession with SETTINGS and then ``settings``; dots in names may be written as two underscores."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    return builder.config(map=SETTINGS | {k.replace("__", "."): v for k, v in settings.items()}).getOrCreate()


def views(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = TABLES) -> None:
    """Temporary views over a folder of Parquet tables."""
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


@dataclasses.dataclass(frozen=True)
class Node:
    node_id: str
    uri: str


class Cluster:
    """The server of the control functions: running or not, with a port, workers and driver entries."""

    def __init__(self):
        self.port: int | None = None
        self.workers: dict[str, Node] = {}
        self.drivers: dict[str, Node] = {}
        self.standalone_ports: set[int] = set()

    @property
    def running(self) -> bool:
        return self.port is not None

    def start(self, port: int = DEFAULT_PORT, workers: int = 0) -> bool:
        """Starts, or restarts with these workers."""
        if workers < 0:
            raise ValueError("the number of workers can't be negative")
        self.stop()
        self.port = port
        self.workers = {f"local-{i}": Node(f"local-{i}", f"local://{port}/{i}") for i in range(workers)}
        return True

    def stop(self) -> bool:
        self.port = None
        self.workers.clear()
        self.drivers.clear()
        self.standalone_ports.clear()
        return True

    def worker_count(self) -> int:
        return len(self.workers)

    def register_worker(self, node_id: str, uri: str) -> bool:
        if not self.running:
            raise RuntimeError("no server is running; start one before registering workers")
        self.workers[node_id] = Node(node_id, uri)
        return True

    def register_or_replace_driver(self, node_id: str, uri: str) -> bool:
        if not self.running:
            raise RuntimeError("no server is running; start one before registering drivers")
        self.drivers[node_id] = Node(node_id, uri)
        return True

    def start_standalone_worker(self, port: int = 0) -> bool:
        """Registers a worker of its own; a port that one has already is an error (0: the next free one)."""
        if port == 0:
            port = max(self.standalone_ports, default=DEFAULT_PORT) + 1
        if port in self.standalone_ports:
            raise ValueError(f"a standalone worker is running on port {port} already")
        self.standalone_ports.add(port)
        self.workers[f"standalone-{port}"] = Node(f"standalone-{port}", f"standalone://{port}")
        return True
