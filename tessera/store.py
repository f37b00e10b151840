"""Tables on shared storage: Parquet files, and a version file per change that names the current ones.

A change writes new data files, then the next version file under a name of its own, and moves that to its place, which fails if another change came
first; readers see the version before or the version after, never half a file. That holds where a rename that must not replace is one step (HDFS); an
object store needs its conditional put instead. Files are named relative to the table's folder, so renaming a table is one move. Columns are kept by number, so adding, dropping, renaming and retyping them touches no data: files keep the columns that they
were written with, and a read brings them to the current ones. DELETE and UPDATE rewrite only files that hold a matching row.
"""

from __future__ import annotations

import copy
import json
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.registry import CatalogError
from tessera.types import EnumRegistry, checked, spark_type


class Files:
    """The few file operations that the store needs, through Hadoop, so that any shared store will do."""

    def __init__(self, spark: SparkSession, root: str):
        jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.path = jvm.org.apache.hadoop.fs.Path
        self.gateway, self.context = spark.sparkContext._gateway, jvm.org.apache.hadoop.fs.FileContext
        self.rename_kind = getattr(jvm, "org.apache.hadoop.fs.Options$Rename")
        self.fs = self.path(root).getFileSystem(self.conf)
        self.utils = jvm.org.apache.commons.io.IOUtils
        self.utf8 = jvm.java.nio.charset.StandardCharsets.UTF_8

    def names(self, folder: str) -> list[str]:
        p = self.path(folder)
        found = (s.getPath().getName() for s in self.fs.listStatus(p)) if self.fs.exists(p) else ()
        return sorted(n for n in found if not n.startswith("."))

    def read(self, path: str) -> str:
        stream = self.fs.open(self.path(path))
        try:
            return self.utils.toString(stream, self.utf8)
        finally:
            stream.close()

    def create(self, path: str, text: str, replace: bool = False) -> None:
        """The whole text appears at the path at once; fails if the path exists, unless it may be replaced."""
        folder, _, name = path.rpartition("/")
        own = f"{folder}/.{name}-{uuid.uuid4().hex}"
        stream = self.fs.create(self.path(own), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        try:
            kinds = self.gateway.new_array(self.rename_kind, 1)
            kinds[0] = self.rename_kind.OVERWRITE if replace else self.rename_kind.NONE
            self.context.getFileContext(self.path(own).toUri(), self.conf).rename(self.path(own), self.path(path), kinds)
        finally:
            self.fs.delete(self.path(own), False)

    def delete(self, path: str) -> bool:
        return self.fs.delete(self.path(path), True)

    def rename(self, old: str, new: str) -> None:
        if not self.fs.rename(self.path(old), self.path(new)):
            raise OSError(f"{old} can't be renamed to {new}")


class Catalogue:
    """Small things that are kept beside the tables: types, views, schemas, each a file of JSON."""

    def __init__(self, files: Files, root: str):
        self.files, self.root = files, f"{root}/_catalogue"

    def path(self, kind: str, name: str) -> str:
        return f"{self.root}/{kind}/{name.lower()}.json"

    def names(self, kind: str) -> list[str]:
        return [n.removesuffix(".json") for n in self.files.names(f"{self.root}/{kind}")]

    def get(self, kind: str, name: str) -> dict | None:
        return json.loads(self.files.read(self.path(kind, name))) if name.lower() in self.names(kind) else None

    def put(self, kind: str, name: str, what: dict, replace: bool = False) -> None:
        self.files.create(self.path(kind, name), json.dumps(what), replace)

    def drop(self, kind: str, name: str) -> bool:
        return bool(self.files.delete(self.path(kind, name)))


class TableStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.files = Files(spark, self.root)
        self.catalogue = Catalogue(self.files, self.root)
        self.enums = EnumRegistry(self.catalogue)

    # versions

    def folder(self, name: str) -> str:
        return f"{self.root}/{name.lower()}"

    def exists(self, name: str) -> bool:
        return bool(self.files.names(f"{self.folder(name)}/versions"))

    def tables(self) -> list[str]:
        return [n for n in self.files.names(self.root) if self.exists(n)]

    def meta(self, name: str) -> dict:
        versions = self.files.names(f"{self.folder(name)}/versions")
        if not versions:
            raise CatalogError(f"Table with name {name} does not exist")
        return json.loads(self.files.read(f"{self.folder(name)}/versions/{versions[-1]}")) | {"name": name}

    def commit(self, name: str, meta: dict) -> None:
        meta["version"] += 1
        self.files.create(f"{self.folder(name)}/versions/{meta['version']:012d}.json", json.dumps({k: v for k, v in meta.items() if k != "name"}))

    def places(self, meta: dict, files: list[str]) -> list[str]:
        return [f"{self.folder(meta['name'])}/{f}" for f in files]

    # DDL

    def create(self, name: str, columns: list[dict], if_not_exists: bool = False) -> None:
        """columns: dicts of name and type, and optionally default (SQL text) and nullable."""
        if self.exists(name):
            if if_not_exists:
                return
            raise CatalogError(f"Table with name {name} already exists")
        names = [c["name"].lower() for c in columns]
        if len(set(names)) != len(names) or not names:
            raise CatalogError("a table needs columns, each name once")
        for c in columns:
            spark_type(c["type"], self.enums)
        own = [{"id": i, "name": c["name"], "type": c["type"], "default": c.get("default"), "initial": None, "nullable": c.get("nullable", True)} for i, c in enumerate(columns)]
        self.commit(name, {"version": 0, "columns": own, "next_id": len(own), "groups": [], "indexes": {}})

    def drop(self, name: str, if_exists: bool = False) -> bool:
        if not self.exists(name):
            if if_exists:
                return False
            raise CatalogError(f"Table with name {name} does not exist")
        self.files.delete(self.folder(name))
        return True

    def rename(self, name: str, new: str) -> None:
        """One move of the folder: the version file names files relative to it."""
        self.meta(name)
        if self.exists(new):
            raise CatalogError(f"Table with name {new} already exists")
        self.files.rename(self.folder(name), self.folder(new))

    @staticmethod
    def column(meta: dict, name: str) -> dict | None:
        return next((c for c in meta["columns"] if c["name"].lower() == name.lower()), None)

    def wanted(self, meta: dict, name: str, table: str) -> dict:
        if (c := self.column(meta, name)) is None:
            raise CatalogError(f"Table {table} does not have a column with name {name}")
        return c

    def add_column(self, name: str, column: str, kind: str, default: str | None = None, if_not_exists: bool = False, nullable: bool = True) -> None:
        """Rows that are there take the default, or null."""
        meta = self.meta(name)
        if self.column(meta, column):
            if if_not_exists:
                return
            raise CatalogError(f"Column with name {column} already exists")
        spark_type(kind, self.enums)
        if not nullable and default is None and meta["groups"]:
            raise CatalogError(f"Column {column} is NOT NULL and has no default for the rows that are there")
        meta["columns"].append({"id": meta["next_id"], "name": column, "type": kind, "default": default, "initial": default, "nullable": nullable})
        meta["next_id"] += 1
        self.commit(name, meta)

    def drop_column(self, name: str, column: str, if_exists: bool = False) -> None:
        meta = self.meta(name)
        if not self.column(meta, column) and if_exists:
            return
        c = self.wanted(meta, column, name)
        if len(meta["columns"]) == 1:
            raise CatalogError("a table's only column can't be dropped")
        if used := [i for i, columns in meta["indexes"].items() if column.lower() in (x.lower() for x in columns)]:
            raise CatalogError(f"Column {column} is in index {used[0]}")
        meta["columns"].remove(c)
        self.commit(name, meta)

    def rename_column(self, name: str, column: str, new: str) -> None:
        meta = self.meta(name)
        c = self.wanted(meta, column, name)
        if self.column(meta, new):
            raise CatalogError(f"Column with name {new} already exists")
        c["name"] = new
        meta["indexes"] = {i: [new if x.lower() == column.lower() else x for x in columns] for i, columns in meta["indexes"].items()}
        self.commit(name, meta)

    def set_type(self, name: str, column: str, kind: str) -> None:
        """Fails, and changes nothing, if a value can't be cast."""
        meta = self.meta(name)
        c = self.wanted(meta, column, name)
        spark_type(kind, self.enums)
        c["type"] = kind
        self.frame(meta).agg(F.max(F.hash(F.col(f"`{c['name']}`")))).collect()  # casts every value, on the executors
        self.commit(name, meta)

    def set_default(self, name: str, column: str, default: str | None) -> None:
        meta = self.meta(name)
        self.wanted(meta, column, name)["default"] = default
        self.commit(name, meta)

    def set_nullable(self, name: str, column: str, nullable: bool) -> None:
        meta = self.meta(name)
        c = self.wanted(meta, column, name)
        if not nullable and not self.frame(meta).where(F.col(f"`{c['name']}`").isNull()).isEmpty():
            raise CatalogError(f"Column {column} holds nulls")
        c["nullable"] = nullable
        self.commit(name, meta)

    def create_index(self, index: str, table: str, columns: list[str], if_not_exists: bool = False) -> None:
        """Metadata only: Spark's Parquet scans skip by statistics; there are no secondary indexes to look things up in."""
        if index.lower() in {i["index_name"].lower() for i in self.indexes()}:
            if if_not_exists:
                return
            raise CatalogError(f"Index with name {index} already exists")
        meta = self.meta(table)
        for c in columns:
            self.wanted(meta, c, table)
        meta["indexes"][index] = columns
        self.commit(table, meta)

    def drop_index(self, index: str, if_exists: bool = False) -> None:
        for table in self.tables():
            meta = self.meta(table)
            for name in list(meta["indexes"]):
                if name.lower() == index.lower():
                    del meta["indexes"][name]
                    return self.commit(table, meta)
        if not if_exists:
            raise CatalogError(f"Index with name {index} does not exist")

    def indexes(self) -> list[dict]:
        return [{"index_name": i, "table_name": t, "columns": c} for t in self.tables() for i, c in self.meta(t)["indexes"].items()]

    # reading

    def schema(self, meta: dict) -> T.StructType:
        return T.StructType([T.StructField(c["name"], spark_type(c["type"], self.enums)) for c in meta["columns"]])

    def read(self, name: str) -> DataFrame:
        return self.frame(self.meta(name))

    def frame(self, meta: dict) -> DataFrame:
        parts = [self.group(meta, g) for g in meta["groups"]]
        if not parts:
            return self.spark.createDataFrame([], self.schema(meta))
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out

    def group(self, meta: dict, group: dict) -> DataFrame:
        """The rows of files that were written with one set of columns, as the current ones."""
        stored = T.StructType([T.StructField(f"c{i}", T._parse_datatype_string(kind)) for i, kind in group["columns"].items()])
        raw = self.spark.read.schema(stored).parquet(*self.places(meta, group["files"]))
        return raw.select(*self.current(meta, group))

    def current(self, meta: dict, group: dict) -> list[Column]:
        out = []
        for c in meta["columns"]:
            kind = spark_type(c["type"], self.enums)
            kept = group["columns"].get(str(c["id"]))
            value = F.col(f"c{c['id']}") if kept else F.expr(c["initial"] if c["initial"] is not None else "null")
            out.append((value if kept == kind.simpleString() else value.cast(kind)).alias(c["name"]))
        return out

    def row_count(self, name: str) -> int:
        return sum(g["rows"] for g in self.meta(name)["groups"])

    # DML

    def write(self, name: str, meta: dict, rows: DataFrame) -> dict | None:
        """Writes rows (the current columns, in order) to new files; what the version file says of them, or None if there are none."""
        folder = f"data/{uuid.uuid4().hex}"
        values = []
        for field, c in zip(rows.columns, meta["columns"], strict=True):
            value = checked(F.col(f"`{field}`"), c["type"], self.enums)
            if not c["nullable"]:
                value = F.when(value.isNull(), F.raise_error(F.lit(f"NOT NULL constraint failed: {name}.{c['name']}"))).otherwise(value)
            values.append(value.cast(spark_type(c["type"], self.enums)).alias(f"c{c['id']}"))
        written = Observation()
        rows.select(*values).observe(written, F.count(F.lit(1)).alias("rows")).write.parquet(f"{self.folder(name)}/{folder}")
        files = [f"{folder}/{n}" for n in self.files.names(f"{self.folder(name)}/{folder}") if n.startswith("part-")]
        kinds = {str(c["id"]): spark_type(c["type"], self.enums).simpleString() for c in meta["columns"]}
        return {"columns": kinds, "files": files, "rows": written.get["rows"]} if written.get["rows"] else None

    @staticmethod
    def joined(groups: list[dict]) -> list[dict]:
        """Groups of the same columns as one."""
        out: list[dict] = []
        for g in groups:
            same = next((o for o in out if o["columns"] == g["columns"]), None)
            if same:
                same["files"], same["rows"] = same["files"] + g["files"], same["rows"] + g["rows"]
            elif g["files"]:
                out.append(copy.deepcopy(g))
        return out

    def insert(self, name: str, rows: DataFrame, columns: list[str] | None = None) -> int:
        """Columns that aren't named take their defaults. Returns the number of rows."""
        meta = self.meta(name)
        if columns is None:
            columns = [c["name"] for c in meta["columns"]]
        if len(columns) != len(rows.columns):
            raise CatalogError(f"table {name} has {len(columns)} columns but {len(rows.columns)} values were supplied")
        given = {self.wanted(meta, c, name)["id"]: f for c, f in zip(columns, rows.toDF(*(f"v{i}" for i in range(len(columns)))).columns, strict=True)}
        rows = rows.toDF(*(f"v{i}" for i in range(len(columns))))
        full = rows.select(*((F.col(given[c["id"]]) if c["id"] in given else F.expr(c["default"] if c["default"] is not None else "null")).alias(f"w{c['id']}") for c in meta["columns"]))
        new = self.write(name, meta, full)
        if new:
            meta["groups"] = self.joined([*meta["groups"], new])
            self.commit(name, meta)
        return new["rows"] if new else 0

    def rewrite(self, name: str, predicate: str | None, change: dict[str, str] | None) -> int:
        """Replaces the files that hold a matching row: without those rows, or with some columns changed in them."""
        meta = self.meta(name)
        for c in change or {}:
            self.wanted(meta, c, name)
        hit = F.coalesce(F.expr(predicate), F.lit(False)) if predicate else F.lit(True)
        matched, kept, new = 0, [], []
        for group in meta["groups"]:
            stored = T.StructType([T.StructField(f"c{i}", T._parse_datatype_string(kind)) for i, kind in group["columns"].items()])
            raw = self.spark.read.schema(stored).parquet(*self.places(meta, group["files"]))
            found = raw.select(*self.current(meta, group), F.col("_metadata.file_path").alias("__file")).alias(name.rsplit(".", 1)[-1])
            # the predicate as it stands, so that files and row groups are skipped by their statistics
            found = found.where(predicate) if predicate else found
            touched = {r["__file"]: r["n"] for r in found.groupBy("__file").agg(F.count("*").alias("n")).collect()}
            if not touched:
                kept.append(group)
                continue
            names = {"/".join(f.rsplit("/", 2)[-2:]) for f in touched}
            old = [f for f in group["files"] if "/".join(f.rsplit("/", 2)[-2:]) in names]
            matched += sum(touched.values())
            rows = self.group(meta, group | {"files": old}).alias(name.rsplit(".", 1)[-1])
            columns, seen = rows.columns, Observation()
            rows = rows.withColumn("__hit", hit).observe(seen, F.count(F.lit(1)).alias("rows"))
            if change is None:
                rows = rows.where("not __hit").select(*(f"`{c}`" for c in columns))
            else:
                sets = {self.column(meta, c)["name"]: v for c, v in change.items()}
                rows = rows.select(*(F.when(F.col("__hit"), F.expr(sets[c]).cast(rows.schema[c].dataType)).otherwise(F.col(f"`{c}`")).alias(c) if c in sets else F.col(f"`{c}`") for c in columns))
            written = self.write(name, meta, rows)
            kept.append(group | {"files": [f for f in group["files"] if f not in old], "rows": group["rows"] - seen.get["rows"]})
            if written:
                new.append(written)
        if matched:
            meta["groups"] = self.joined([g for g in [*kept, *new] if g["files"]])
            self.commit(name, meta)
        return matched

    def compact(self, name: str, rows_per_file: int = 1_000_000) -> int:
        """Rewrites the table into files of about so many rows, in the current columns, as one group. Returns the number of files."""
        meta = self.meta(name)
        total = sum(g["rows"] for g in meta["groups"])
        if not total:
            return 0
        new = self.write(name, meta, self.frame(meta).repartition(-(-total // rows_per_file)))
        meta["groups"] = [new]
        self.commit(name, meta)
        return len(new["files"])

    def delete(self, name: str, predicate: str | None = None) -> int:
        """Rows for which the predicate is null stay. Returns the number of rows deleted."""
        return self.rewrite(name, predicate, None)

    def update(self, name: str, change: dict[str, str], predicate: str | None = None) -> int:
        return self.rewrite(name, predicate, change)
