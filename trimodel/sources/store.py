"""Managed tables without a table format: immutable Parquet parts and numbered manifests.

A manifest is one JSON file that lists every namespace and table with its parts. A writer claims the next number by an
exclusive create, writes the manifest aside and renames it: a reader never sees a half-written one, and the first of two
writers wins while the other retries or fails. A claim that a dead writer left behind is taken over after a minute.
Parts are never changed: a put adds one, a change or removal replaces those that hold matching rows. Readers keep what
they began with. Small parts are merged when a table has more than `MOST_PARTS`, and `vacuum` deletes old manifests and
the parts that no manifest lists. All paths go through Hadoop's file systems, so the folder may be on any store that
Spark writes to.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trimodel.errors import TransactionError


#: Parts of a table beyond which small ones are merged, bytes from which on a part isn't small, and ms that a claim holds.
MOST_PARTS, SMALL, CLAIM_MS = 32, 128 << 20, 60_000


@dataclass
class Column:
    name: str
    type: str = "string"
    primary: bool = False
    unique: bool = False
    required: bool = False
    default: dict | None = None  # as sources.catalog.dump_expr gives it


@dataclass
class Index:
    name: str
    columns: list[str]
    unique: bool = False


@dataclass
class Table:
    """parts: folders below the store; schema: the rows' Spark schema as JSON."""

    name: str
    model: str
    columns: list[Column] = field(default_factory=list)
    indexes: list[Index] = field(default_factory=list)
    ttl: int | None = None
    description: str | None = None
    parts: list[str] = field(default_factory=list)
    schema: str = '{"type":"struct","fields":[]}'
    version: int = 0

    @property
    def struct(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.schema))

    @staticmethod
    def of(d: dict) -> Table:
        return Table(**d | {"columns": [Column(**c) for c in d["columns"]], "indexes": [Index(**i) for i in d["indexes"]]})


@dataclass
class Manifest:
    number: int = 0
    namespaces: dict[str, str | None] = field(default_factory=lambda: {"default": None, "system": None})
    tables: dict[str, Table] = field(default_factory=dict)

    def dump(self) -> str:
        return json.dumps({"number": self.number, "namespaces": self.namespaces, "tables": {k: asdict(t) for k, t in self.tables.items()}})

    @staticmethod
    def load(text: str) -> Manifest:
        d = json.loads(text)
        return Manifest(d["number"], d["namespaces"], {k: Table.of(t) for k, t in d["tables"].items()})


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/manifests"))

    def latest(self) -> Manifest:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/manifests"))]
        last = max((n for n in names if n.endswith(".json")), default=None)
        if last is None:
            return Manifest()
        return self._load(last)

    def _load(self, name: str) -> Manifest:
        stream = self._fs.open(self._path(f"{self.root}/manifests/{name}"))
        try:
            return Manifest.load(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, manifest: Manifest) -> None:
        """Publish the next manifest; TransactionError if another writer has its number."""
        done, claim = (self._path(f"{self.root}/manifests/{manifest.number + 1:012d}.{kind}") for kind in ("json", "claim"))
        self._claim(claim)
        aside = self._path(f"{self.root}/manifests/{uuid.uuid4().hex}.tmp")
        try:
            if self._fs.exists(done):
                raise TransactionError("another session committed first")
            manifest.number += 1
            out = self._fs.create(aside, False)
            try:
                out.write(manifest.dump().encode())
            finally:
                out.close()
            if self._fs.exists(done) or not self._fs.rename(aside, done):
                manifest.number -= 1
                raise TransactionError("another session committed first")
        finally:
            self._fs.delete(aside, False)
            self._fs.delete(claim, False)

    def _claim(self, claim) -> None:
        try:
            self._fs.create(claim, False).close()
        except Exception as e:
            if not self._fs.exists(claim):
                raise
            if time.time() * 1000 - self._fs.getFileStatus(claim).getModificationTime() > CLAIM_MS:
                self._fs.delete(claim, False)  # its writer is gone
            else:
                time.sleep(0.05)
            raise TransactionError("another session is committing") from e

    def write(self, df: DataFrame) -> str:
        part = f"parts/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{part}")
        return part

    def read(self, table: Table, parts: list[str] | None = None, named: bool = False) -> DataFrame:
        """A table's rows in its schema (of some parts only); columns that a part lacks are NULL. named: with tm_part."""
        found = [f"{self.root}/{p}" for p in (table.parts if parts is None else parts)]
        if not found:
            rows = self.spark.createDataFrame([], table.struct)
            return rows.withColumn("tm_part", F.lit("")) if named else rows
        rows = self.spark.read.schema(table.struct).parquet(*found)
        return rows.select("*", F.regexp_extract("_metadata.file_path", r"(parts/[0-9a-f]{32})/", 1).alias("tm_part")) if named else rows

    def size(self, part: str) -> int:
        return self._fs.getContentSummary(self._path(f"{self.root}/{part}")).getLength()

    def merged(self, table: Table) -> None:
        """The table with its small parts as one, if it has more than MOST_PARTS."""
        if len(table.parts) <= MOST_PARTS:
            return
        sizes = {p: self.size(p) for p in table.parts}
        small = [p for p in table.parts if sizes[p] < SMALL]
        if len(small) > 1:
            total = sum(sizes[p] for p in small)
            table.parts = [*(p for p in table.parts if p not in set(small)), self.write(self.read(table, small).coalesce(max(1, total // SMALL)))]

    def vacuum(self, keep: int = 1, older_ms: int = 3_600_000) -> int:
        """Delete manifests but the last `keep`, and parts that these don't list. Nothing younger than older_ms goes: a
        writer may be about to list it, a reader to read it. Returns the number of parts deleted."""
        before, root = time.time() * 1000 - older_ms, f"{self.root}/manifests"
        files = sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(root)) if s.getPath().getName().endswith(".json"))
        listed: set[str] = set()
        for name in files:
            path = self._path(f"{root}/{name}")
            if name in files[-keep:] or self._fs.getFileStatus(path).getModificationTime() >= before:
                listed |= {p for t in self._load(name).tables.values() for p in t.parts}
            else:
                self._fs.delete(path, False)
        gone = 0
        if self._fs.exists(self._path(f"{self.root}/parts")):
            for s in self._fs.listStatus(self._path(f"{self.root}/parts")):
                name = f"parts/{s.getPath().getName()}"
                if name not in listed and s.getModificationTime() < before and re.fullmatch(r"parts/[0-9a-f]{32}", name):
                    self._fs.delete(s.getPath(), True)
                    gone += 1
        return gone
