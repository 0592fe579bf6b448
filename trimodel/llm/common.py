"""What the corpus operators share: shared scratch tables, local ranks and connected components."""

from __future__ import annotations

import gc
import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package, keep Arrow batches small in bytes, not only in rows, and bound the driver's threads."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    # The pools that start exchanges take a new thread for each, up to 1,024, which stays for a minute with its stack: the
    # many short jobs of components would fill the driver's memory with them. The pools are made at their first use.
    pools = spark._jsparkSession.sessionState().conf()
    for name in ("shuffleExchange", "broadcastExchange", "resultQueryStage"):
        pools.setConfString(f"spark.sql.{name}.maxThreadThreshold", "16")


def scratch(spark: SparkSession) -> str:
    """A fresh path in the shared folder of spark.checkpoint.dir; where that is unset (tests), below the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "_scratch")
    return f"{base.rstrip('/')}/trimodel-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored(df: DataFrame) -> DataFrame:
    """As written, with zstd: for tables of hashes and texts."""
    path = scratch(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, column: str) -> DataFrame:
    """As stored, dealt by a column: joins by it don't shuffle the table. It is in the session's catalog until discarded."""
    spark, name = df.sparkSession, f"trimodel_{uuid.uuid4().hex}"
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    df.write.bucketBy(n, column).option("compression", "zstd").option("path", scratch(spark)).saveAsTable(name)
    return spark.table(name)


def discard(spark: SparkSession, *tables: DataFrame, shuffles: bool = True) -> None:
    """Delete scratch tables that nothing reads any more, and let Spark drop the shuffles that made them."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    found = {os.path.dirname(f) for t in tables for f in t.inputFiles()}
    for table in spark.catalog.listTables() if any("trimodel_" in t._jdf.queryExecution().analyzed().toString() for t in tables) else []:
        if table.name.startswith("trimodel_") and any(table.name in t._jdf.queryExecution().analyzed().toString() for t in tables):
            spark.sql(f"DROP TABLE IF EXISTS {table.name}")
    for path in found:
        if "/trimodel-" in path:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)
    if shuffles:
        gc.collect()
        jvm.System.gc()  # Spark's cleaner removes the files of shuffles whose plans are gone
    trim(spark)


def trim(spark: SparkSession) -> str | None:
    """Memory that the driver's JVM has freed outside its heap (threads and compiled plans of many jobs) goes back to the
    system, by the JVM's own diagnostic command; what it says, or None where the JVM has no such command."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway

    def array(of: object, *items: object) -> object:
        out = gateway.new_array(of, len(items))
        for k, x in enumerate(items):
            out[k] = x
        return out

    try:  # the server's class is not open to py4j, its interface is
        named = jvm.java.lang.Class.forName
        types = array(jvm.java.lang.Class, *map(named, ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")))
        invoke = named("javax.management.MBeanServer").getMethod("invoke", types)
        bean = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        return invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), array(jvm.java.lang.Object, bean, "systemTrimNativeHeap", None, None))
    except Py4JError:
        return None


#: Bits of a sieve, which is 2 MB however long its table is.
SIEVE = 1 << 24


def sieved(df: DataFrame, keys: list[str], table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """df in two parts: rows whose keys table (all its columns, of the same types) may have, and those whose it surely
    hasn't. A null is a key like any other. Where few rows can match, the others need no exchange; the longer the table,
    the more rows the first part has, but it never lacks one."""
    place = lambda columns: F.pmod(F.xxhash64(*columns), F.lit(SIEVE))
    block, bits = free(df, "tm_block", "tm_bits")
    at = table.select(place([F.col(f"`{c}`") for c in table.columns]).alias("at"))
    of_block = at.groupBy(F.shiftright("at", 15).alias(block)).agg(F.bitmap_construct_agg(F.col("at").bitwiseAND(32767)).alias(bits))
    own = place([F.col(f"`{c}`") for c in keys])
    byte = F.substring(F.col(bits), (F.shiftright(own.bitwiseAND(32767), 3) + 1).cast("int"), F.lit(1))
    bit = F.call_function("shiftright", F.conv(F.hex(byte), 16, 10).cast("int"), own.bitwiseAND(7).cast("int")).bitwiseAND(1)
    with_bits = df.join(F.broadcast(written(of_block)), F.shiftright(own, 15) == F.col(block), "left")
    may = F.coalesce(bit, F.lit(0)) == 1
    return tuple(with_bits.where(x).drop(block, bits) for x in (may, ~may))


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, each with a number behind where df (or another of them) has it already, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        k, new = 1, name
        while new.lower() in taken:
            k, new = k + 1, f"{name}{k}"
        taken.add(new.lower())
        out.append(new)
    return out


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, and at the end of each partition the memory that the worker no longer needs goes back to the system: workers
    are used again, and what one stage took would add to the next one's."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return held


def give_back() -> None:
    import ctypes

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: T.StructType) -> DataFrame:
    """mapInArrow with a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and (out := fn(b)) is not None and out.num_rows:
                yield out

    return df.mapInArrow(released(run), schema)


def texts(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """UTF-8 bytes of a text column; null is empty."""
    return [x or b"" for x in batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()]


def local_ranks(df: DataFrame, by: str, pid: str = "tm_pid", rank: str = "tm_rank") -> DataFrame:
    """A written table of df plus the partition's number and each row's rank among the partition's rows of its class.

    by: an integer column without nulls. A class may hold any share of the rows: no task ever gathers a class."""
    schema = T.StructType([*df.schema.fields, T.StructField(pid, T.IntegerType()), T.StructField(rank, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        me, seen = TaskContext.get().partitionId(), {}
        for b in batches:
            k = b.column(b.schema.get_field_index(by)).to_numpy(zero_copy_only=False).astype(np.int64)
            order = np.argsort(k, kind="stable")
            s = k[order]
            first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, np.int64)
            n = np.diff(np.r_[first, len(s)])
            within = np.arange(len(s)) - np.repeat(first, n)
            base = np.array([seen.get(int(x), 0) for x in s[first]], dtype=np.int64)
            for x, c in zip(s[first].tolist(), n.tolist(), strict=True):
                seen[x] = seen.get(x, 0) + c
            r = np.empty(len(s), np.int64)
            r[order] = within + np.repeat(base, n)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(s), me, np.int32)), pa.array(r)], names=[*b.schema.names, pid, rank])

    return written(df.mapInArrow(released(run), schema))


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its component) that say the same as the edges (a, b)."""
    nodes, ix = np.unique(np.r_[a, b], return_inverse=True)
    x, y = ix[: len(a)], ix[len(a) :]
    root = np.arange(len(nodes))
    while True:
        rx, ry = root[x], root[y]
        lo, hi = np.minimum(rx, ry), np.maximum(rx, ry)
        if not (open_ := lo != hi).any():
            break
        np.minimum.at(root, hi[open_], lo[open_])
        while (root[root] != root).any():
            root = root[root]
    keep = root != np.arange(len(nodes))
    return nodes[keep], nodes[root[keep]]


EDGES = T.StructType([T.StructField("hi", T.LongType()), T.StructField("lo", T.LongType())])


def contracted(edges: DataFrame) -> DataFrame:
    """Each batch of edges (a, b) as a forest of stars (hi, lo): no more than one edge for each node of the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0

        def flush() -> pa.RecordBatch:
            both = np.concatenate(held, axis=1) if held else np.zeros((2, 0), np.int64)
            hi, lo = _forest(both[0], both[1])
            return pa.RecordBatch.from_arrays([pa.array(hi), pa.array(lo)], names=["hi", "lo"])

        for batch in batches:
            held.append(np.stack([batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)]).astype(np.int64))
            n += batch.num_rows
            if n >= 500_000:  # bounds memory; any number gives the same components
                yield flush()
                held, n = [], 0
        if n:
            yield flush()

    return edges.mapInArrow(released(run), EDGES)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the smallest node reachable. Nodes are longs.

    Alternating large-star and small-star steps over written tables until nothing changes. A hub's edges are never
    gathered: minima are partial aggregates, and the joins have a shuffle on both sides, so that AQE splits hot keys."""
    a, b = edges.columns[:2]
    e = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a is not null and b is not null and a <> b")
    e = written(contracted(e).distinct())
    seen = None
    while True:
        row = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if tuple(row) == seen or row[0] == 0:
            return e.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(e.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
        seen = tuple(row)
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        first = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = written(both.where("v > u").join(first, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct())
        least = written(large.groupBy("hi").agg(F.min("lo").alias("m")))
        small = large.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        new = written(small.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct())
        discard(e.sparkSession, e, first, large, least, shuffles=False)
        e = new
