"""Embedding near-duplicates by sorted projection passes.

Each pass draws random hyperplanes, concatenates a vector's sign bits into one key, sorts all vectors lexicographically
by it over all tasks, and compares each vector with its next `window` neighbours in the order. Pairs at the threshold
or above, verified in double precision, are links; the links of all passes are united into components.

A window sees little of a crowded place, so trees follow: each splits the vectors by random directions, at the local
median, until at most `LEAF` are left, which are compared in full. A dense region has as many leaves as its share of the
rows. Trees are added, four at a time, until four find next to nothing new.

Then the links inside the components are completed, so that no window, however small against a dense group, loses one:
a member whose angle to the component's mean, plus the widest such angle, stays below the threshold's is linked with
all the others by the triangle inequality, without a comparison; the rest are compared in blocks, dealt over all tasks.

Equal vectors are one entry with a weight: copies are never compared with each other, and add their count to n_links.
The passes read each distinct vector `passes` times; a task holds one block of rows at a time.

Defined results: a null or zero vector, or one with a null or non-finite component, links with nothing and is its own
component; vectors link only with those of their own length; equal vectors link with each other; rows with equal ids are one
vector if their embeddings are equal; a null id is kept and counted, with component null; an empty table gives an empty
result; further columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trimodel.llm.common import EDGES, _forest, components, contracted, discard, map_batches, prepare, released, written

BITS = 63
#: Vectors of a leaf, and of the sample a tree's top is cut by.
LEAF, SAMPLE = 1024, 65_536


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of unit length, as doubles."""
    x = np.stack(column.to_numpy(zero_copy_only=False)).astype(np.float64) if len(column) else np.zeros((0, 1))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _valid(column: str) -> F.Column:
    x = F.transform(F.col(column), lambda v: v.cast("double"))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.coalesce(F.col(column).isNotNull() & finite & F.exists(x, lambda v: v != 0), F.lit(False))


def _passes(vectors: DataFrame, numbers: range, threshold: float, window: int, tasks: int) -> DataFrame:
    """Verified pairs (hi, lo) of some passes, as stars by batch. The passes share one sort, pass by pass; what meets at
    the border of two is verified like all else. vectors: rep, v."""
    keyed = T.StructType([*vectors.schema.fields, T.StructField("pass", T.IntegerType()), T.StructField("key", T.LongType())])

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1))
            for k in numbers:
                planes = np.random.default_rng([k, x.shape[1]]).standard_normal((x.shape[1], BITS))
                bits = (x @ planes > 0).astype(np.int64) @ (np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(x), k, np.int32)), pa.array(bits)], names=keyed.names)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None
        for b in batches:
            ids, x = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64), _matrix(b.column(1))
            if tail is not None:
                ids, x = np.concatenate([tail[0], ids]), np.concatenate([tail[1], x])
            hi, lo = [], []
            for d in range(1, min(window, len(ids) - 1) + 1):
                near = np.flatnonzero(np.einsum("ij,ij->i", x[:-d], x[d:]) >= threshold)
                a, c = ids[near], ids[near + d]
                hi.append(np.maximum(a, c))
                lo.append(np.minimum(a, c))
            tail = ids[-window:], x[-window:]
            if hi:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hi)), pa.array(np.concatenate(lo))], names=["hi", "lo"])

    by_key = vectors.mapInArrow(released(keys), keyed).repartitionByRange(tasks, "pass", "key", "rep").sortWithinPartitions("pass", "key", "rep")
    return contracted(by_key.mapInArrow(released(compare), EDGES))


def _trees(vectors: DataFrame, numbers: range, threshold: float, sample: np.ndarray, n: int) -> DataFrame:
    """Verified pairs (hi, lo) of the leaves of some trees, as stars. The sample sets where the top levels split; what
    falls into one of its leaves is split further by itself. vectors: rep, v, of which there are n."""
    depth = max(0, int(np.log2(max(1, min(len(sample) // 32, n // LEAF)))))
    plans = {}
    for k in numbers:
        rng = np.random.default_rng([k, sample.shape[1], 1])
        planes = rng.standard_normal((sample.shape[1], depth))
        at, cuts = np.zeros(len(sample), np.int64), np.zeros((1 << depth) - 1)
        projected = sample @ planes
        for level in range(depth):
            order = np.lexsort((projected[:, level], at))
            starts = np.searchsorted(at[order], np.arange((1 << level) - 1, (2 << level) - 1))
            ends = np.append(starts[1:], len(at))
            for node, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
                cuts[(1 << level) - 1 + node] = projected[order[(a + b) // 2], level] if b > a else 0
            at = 2 * at + 1 + (projected[:, level] > cuts[at])
        plans[k] = planes, cuts
    keyed = T.StructType([*vectors.schema.fields, T.StructField("tree", T.IntegerType()), T.StructField("node", T.IntegerType())])
    shared = vectors.sparkSession.sparkContext.broadcast(plans)

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1))
            for k, (planes, cuts) in shared.value.items():
                at = np.zeros(len(x), np.int64)
                for level in range(depth):
                    at = 2 * at + 1 + (x @ planes[:, level] > cuts[at])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(x), k, np.int32)), pa.array(at.astype(np.int32))], names=keyed.names)

    def compare(key, table):
        ids = table.column("rep").to_numpy()
        x = _matrix(table.column("v").combine_chunks())
        rng = np.random.default_rng([key[0].as_py(), key[1].as_py(), 2])
        rows, hi, lo = [rng.permutation(len(ids))], [], []
        while rows:
            r = rows.pop()
            if len(r) > LEAF:
                half = np.argpartition(x[r] @ rng.standard_normal(x.shape[1]), len(r) // 2)
                rows += [r[half[: len(r) // 2]], r[half[len(r) // 2 :]]]
                continue
            a, b = np.nonzero(np.triu(x[r] @ x[r].T >= threshold, 1))
            if len(a):
                h, g = _forest(ids[r[a]], ids[r[b]])
                hi.append(h)
                lo.append(g)
        none = [np.zeros(0, np.int64)]
        return pa.table({"hi": pa.array(np.concatenate(hi or none)), "lo": pa.array(np.concatenate(lo or none))})

    return contracted(vectors.mapInArrow(released(leaves), keyed).groupBy("tree", "node").applyInArrow(compare, EDGES))


def _connected(vectors: DataFrame, edges: DataFrame, threshold: float, most: int = 64) -> DataFrame:
    """Components (node, root) of the edges and those that trees add. vectors: rep, v (written)."""
    roots, n = written(components(edges)), vectors.count()
    merged = roots.where("node <> root").count()
    width = vectors.select(F.size("v")).first()
    if n < 2 or width is None:
        return roots
    share = -(-n // max(32, min(SAMPLE, (SAMPLE << 8) // width[0])))
    sample = vectors.where(F.pmod(F.xxhash64("rep", F.lit(3)), F.lit(share)) == 0).select("v").toArrow().column("v").combine_chunks()
    sample = _matrix(sample) if len(sample) else np.zeros((0, width[0]))
    for k in range(0, most, 4):
        edges = written(edges.unionByName(_trees(vectors, range(k, k + 4), threshold, sample, n)))
        roots, before = written(components(edges)), merged
        edges, merged = roots.where("node <> root").select(F.col("node").alias("hi"), F.col("root").alias("lo")), roots.where("node <> root").count()
        if n <= LEAF or 1000 * (merged - before) <= merged:
            break
    return roots


def _completed(members: DataFrame, threshold: float, block: int = 1024) -> DataFrame:
    """(rep, links): links of each vector inside its component, by weight. members: rep, v, n, root."""
    sums = members.select("root", F.posexplode("v").alias("p", "x")).groupBy("root", "p").agg(F.sum(F.col("x").cast("double")).alias("x"))
    centre = sums.groupBy("root").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda r: r["x"]).alias("c"))  # as long as a vector
    centre = written(centre.where(F.exists("c", lambda x: x != 0)))
    angled = T.StructType([T.StructField("rep", T.LongType()), T.StructField("v", members.schema["v"].dataType), T.StructField("n", T.LongType()), T.StructField("root", T.LongType()), T.StructField("angle", T.DoubleType())])

    def angle(batch: pa.RecordBatch) -> pa.RecordBatch:
        cos = np.einsum("ij,ij->i", _matrix(batch.column(1)), _matrix(batch.column(4)))
        return pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(np.arccos(np.clip(cos, -1, 1)))], names=angled.names)

    pointed = members.join(centre, "root", "left").withColumn("c", F.coalesce("c", F.transform("v", lambda x: x.cast("double"))))
    rows = written(map_batches(pointed.select("rep", "v", "n", "root", "c"), angle, angled))
    limit = float(np.arccos(threshold)) - 1e-6  # the margin leaves pairs near the threshold to a comparison
    sums = written(rows.groupBy("root").agg(F.sum("n").alias("all"), F.max("angle").alias("widest"), F.count(F.lit(1)).alias("rows")))
    rows = rows.join(sums, "root").withColumn("sure", F.col("angle") + F.col("widest") <= limit)
    certain = rows.where("sure").select("rep", (F.col("all") - 1).alias("links"))
    # The others: the component's rows in blocks, each open row against every block of its component.
    open_ = rows.where("not sure")
    parts = F.greatest(F.lit(1), F.ceil(F.col("rows") / block)).cast("int")
    side = open_.withColumn("b", F.explode(F.sequence(F.lit(0), parts - 1))).select("root", "b", "rep", "v", "n", F.lit(True).alias("asks"), F.pmod(F.xxhash64("rep", F.lit(1)), parts).alias("q"))
    asked = open_.select("root", parts.alias("p")).distinct()
    of_block = rows.join(asked, "root").withColumn("q", F.explode(F.sequence(F.lit(0), F.col("p") - 1))).select("root", F.pmod(F.xxhash64("rep"), F.col("p")).cast("int").alias("b"), "rep", "v", "n", F.lit(False).alias("asks"), "q")
    dealt = side.unionByName(of_block.select(*side.columns))
    schema = T.StructType([T.StructField("rep", T.LongType()), T.StructField("links", T.LongType())])

    def count(key, table):
        table = table.combine_chunks()
        asks = table.column("asks").to_numpy(zero_copy_only=False).astype(bool)
        ids, n = table.column("rep").to_numpy(), table.column("n").to_numpy()
        x = _matrix(table.column("v").combine_chunks())
        if not asks.any():
            return pa.table({"rep": pa.array([], pa.int64()), "links": pa.array([], pa.int64())})
        a, b = np.flatnonzero(asks), np.flatnonzero(~asks)
        links = np.zeros(len(a), np.int64)
        for s in range(0, len(a), 512):
            near = x[a[s : s + 512]] @ x[b].T >= threshold
            links[s : s + 512] = near @ n[b]
        return pa.table({"rep": pa.array(ids[a]), "links": pa.array(links)})

    counted = dealt.groupBy("root", "b", "q").applyInArrow(count, schema).groupBy("rep").agg((F.sum("links") - 1).alias("links"))
    return certain.unionByName(counted)


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, passes: int = 16, window: int = 32) -> DataFrame:
    """id, n_links, component_id and kept of every row."""
    spark = vectors.sparkSession
    prepare(spark)
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).withColumn("ok", _valid("v"))
    # Equal vectors by a key of 128 bits: hashing is on what is compared, doubles without the sign of zero.
    plain = F.transform("v", lambda x: x.cast("double") + F.lit(0.0))
    keyed = written(rows.withColumn("k1", F.when(F.col("ok"), F.xxhash64(plain))).withColumn("k2", F.when(F.col("ok"), F.xxhash64(F.lit(7), plain))).withColumn("order", F.coalesce("id", F.lit((1 << 63) - 1))).select("id", "order", "ok", "k1", "k2", "v"))
    groups = keyed.where("ok").groupBy("k1", "k2").agg(F.min("order").alias("first"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v"))
    groups = written(groups.withColumn("rep", F.monotonically_increasing_id()))  # ids may repeat or be null: a number of our own
    lengths = groups.groupBy(F.size("v").alias("size")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy("size").collect()
    members = groups.select("rep", "first", "v", "n", F.lit(0).cast("long").alias("root")).where("false")
    links = members.select("rep", F.lit(0).cast("long").alias("links"))
    for size, _ in lengths:  # only vectors of one length compare; one for each length that is there
        alike = groups.where(F.size("v") == size)
        edges: list[DataFrame] = []
        for k in range(0, passes, 4):  # a few passes at a time bound the disk that shuffles take
            edges.append(written(_passes(alike.select("rep", "v"), range(k, min(k + 4, passes)), threshold, window, tasks)))
        roots = _connected(alike.select("rep", "v"), reduce(DataFrame.unionByName, edges), threshold)
        found = written(alike.join(roots, alike.rep == roots.node).select("rep", "first", "v", "n", "root"))
        members, links = members.unionByName(found), links.unionByName(written(_completed(found.drop("first"), threshold)))
    smallest = written(members.groupBy("root").agg(F.min("first").alias("component_id")))
    linked = written(members.select("rep", "root").join(smallest, "root").join(links, "rep").select(F.col("rep").alias("r"), "component_id", "links"))
    found = groups.select("k1", "k2", "rep", "first", "n").join(linked, F.col("rep") == F.col("r"), "left")
    found = written(found.select(F.col("k1").alias("g1"), F.col("k2").alias("g2"), F.coalesce("links", F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "first").alias("component_id")))
    discard(spark, groups, members, links, smallest, linked)
    out = keyed.join(found, (F.col("k1") == F.col("g1")) & (F.col("k2") == F.col("g2")), "left")
    component = F.coalesce("component_id", "id")
    component = F.when(component != (1 << 63) - 1, component)
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


#: All pairs, for tables small enough.
ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach(vec_id, r) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON reach.r = links.a)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = reach.vec_id) AS n_links, min(r) AS component_id, min(r) = vec_id AS kept FROM reach GROUP BY vec_id
"""
