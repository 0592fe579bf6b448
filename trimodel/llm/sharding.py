"""Sharding by vector bin packing: bytes, tokens and rows balanced jointly.

Rows with equal texts are a group, a vector of (bytes, tokens, rows), and each group goes, the largest first, to the shard
where the dot product with the residual capacity is highest. Groups that are large against a shard (at most `heavy` of
them fit one in any dimension, so their number is bounded) are placed first, on the driver. They stay whole as long as
the sizes of shards can be near equal; else they are cut, as coarsely as will do: no shard holds a group above its share,
and the law comes first. The others are dealt over the
tasks by hash, and each task places its own against the residual capacity in proportion to what it has: no task needs to
see another's choices, and what all leave uneven is less than their last groups.

Ties: of groups alike the one with the smaller hash comes first, of shards with equal products the one with the smaller
number. Defined results: a null text has size 1, no tokens and crc32 0, and is a group with the empty texts; repeated rows
are placed each; a very long text is a group like others; an empty table gives an empty result; further columns aren't
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trimodel.llm.common import discard, local_ranks, prepare, released, written


def place(vectors: np.ndarray, capacity: np.ndarray) -> np.ndarray:
    """The shard of each vector, and the capacity (shard x dimension) reduced by what it got, in place.

    Dimensions count in shares of the mean capacity at the start. A shard that can't hold the vector is taken only if no
    other can."""
    unit = np.maximum(np.abs(capacity).mean(0), 1e-9)
    v, residual = vectors / unit, capacity / unit
    out = np.zeros(len(v), dtype=np.int64)
    for k in np.argsort(-v.max(1), kind="stable") if len(v) else ():
        after = residual - v[k]
        gain = residual @ v[k]
        fits = after.min(1) >= -1e-9
        out[k] = int(np.where(fits, gain, -np.inf).argmax()) if fits.any() else int(gain.argmax())
        residual[out[k]] = after[out[k]]
    capacity[:] = residual * unit
    return out


def _placed(groups: DataFrame, capacity: np.ndarray) -> DataFrame:
    """(tm_group, shard) of light groups: each task takes its share of the capacity. groups: tm_group, b, t, n."""
    schema = T.StructType([T.StructField("tm_group", T.LongType()), T.StructField("shard", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            found = pa.Table.from_batches(held)
            ids, v = (found.column("tm_group").to_numpy(), np.stack([found.column(c).to_numpy() for c in ("b", "t", "n")], axis=1).astype(float))
            order = np.argsort(ids, kind="stable")
            ids, v = ids[order], v[order]
            own = np.maximum(capacity, 0)
            homes = place(v, own * (v.sum(0) / np.maximum(own.sum(0), 1e-9)))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(homes.astype(np.int32))], names=schema.names)

    return groups.select("tm_group", "b", "t", "n").mapInArrow(released(run), schema)


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", heavy: int = 64, uneven: float = 0.005) -> DataFrame:
    """id, size, text_crc32, law (`bytes`), shard, slot and grown_shard (null) of every row. heavy: groups above a
    shard's heavy-th part are placed one by one, at most 3 * shards * heavy. uneven: how far above the mean shard, in bytes,
    whole groups may bring one before groups are cut further."""
    spark = docs.sparkSession
    prepare(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = written(docs.select(
        F.col(id_col),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.regexp_count(text, F.lit(r"\S+")).cast("long").alias("tm_tokens"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("tm_group"),
    ))
    groups = written(rows.groupBy("tm_group").agg(F.sum("size").alias("b"), F.sum("tm_tokens").alias("t"), F.count(F.lit(1)).alias("n")))
    total = np.array([x or 0 for x in groups.agg(F.sum("b"), F.sum("t"), F.sum("n")).first()], dtype=float)
    share = total / shards
    large = F.greatest(*[F.col(c) / F.lit(max(float(s), 1e-9)) for c, s in zip("btn", share, strict=True)])
    listed = sorted(groups.withColumn("x", large).where(F.col("x") * heavy > 1).collect(), key=lambda r: (-r["x"], r["tm_group"]))
    vectors = np.array([[r["b"], r["t"], r["n"]] for r in listed], dtype=float).reshape(-1, 3)
    limit = 1.0
    while True:  # groups stay as whole as even sizes allow
        parts = np.array([min(r["n"], max(1, int(np.ceil(r["x"] / limit - 1e-9)))) for r in listed], dtype=np.int64)
        index = np.repeat(np.arange(len(listed)), parts)
        capacity = np.tile(share, (shards, 1))
        homes = place(vectors[index] / parts[index, None], capacity)
        if capacity[:, 0].min() >= -uneven * share[0] or limit * heavy <= 1:
            break
        limit /= 2
    heads = F.broadcast(spark.createDataFrame([(r["tm_group"], k, int(n)) for k, (r, n) in enumerate(zip(listed, parts, strict=True))], "tm_group long, tm_index long, tm_parts long"))
    # The rows of a group are dealt to its parts by turns in each task; what the parts hold is counted and placed.
    dealt = local_ranks(rows.join(heads, "tm_group").drop("tm_group"), "tm_index")
    dealt = dealt.withColumn("tm_part", F.pmod(F.col("tm_rank") + F.xxhash64("tm_pid"), F.col("tm_parts")))
    held = dealt.groupBy("tm_index", "tm_part").agg(F.sum("size").alias("b"), F.sum("tm_tokens").alias("t"), F.count(F.lit(1)).alias("n")).collect()  # bounded by shards and heavy
    held.sort(key=lambda r: (r["tm_index"], r["tm_part"]))
    capacity = np.tile(share, (shards, 1))
    homes = place(np.array([[r["b"], r["t"], r["n"]] for r in held], dtype=float).reshape(-1, 3), capacity)
    own = F.broadcast(spark.createDataFrame([(r["tm_index"], r["tm_part"], int(h)) for r, h in zip(held, homes, strict=True)], "tm_index long, tm_part long, shard int"))
    cut = dealt.join(own, ["tm_index", "tm_part"])
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    light = written(_placed(groups.join(heads.select("tm_group"), "tm_group", "left_anti").repartition(tasks, "tm_group"), capacity))
    columns = [id_col, "size", "text_crc32", "shard"]
    whole = rows.join(light, "tm_group").select(*columns)
    ranked = local_ranks(whole.unionByName(cut.select(*columns)), "shard")
    counts = ranked.groupBy("shard", "tm_pid").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("shard").orderBy("tm_pid").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    starts = written(counts.select("shard", "tm_pid", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("tm_base")))
    discard(spark, rows, groups, light, dealt)
    return ranked.join(starts, ["shard", "tm_pid"]).select(
        F.col(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("tm_base") + F.col("tm_rank")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
