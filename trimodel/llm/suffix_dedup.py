"""Removal of byte strings that occur more than once, by a sampled suffix index.

Of `length` bytes (200), a string is repeated if it starts at two places anywhere, texts being judged as they came. The
method follows the difference-cover scheme in its parts, with two changes for size (see the README):

- Sample. A difference cover guarantees that two equal suffixes meet a sampled position at the same distance. Here the
  sample is taken by content, the least 32-byte hash of each window of 200 bytes, which gives the same guarantee for
  equal windows at a seventh or less of the positions. A sampled position stands for the run of windows it is least in.
- Names. The run with its anchor is named by hashes rather than ranks, since only equality of 200-byte prefixes is asked.
- Recursion. Anchors with one occurrence drop out. Where all runs of an anchor have one name, all their windows are
  repeated. Only the mixed anchors are looked into further, by blocks of 24 windows: one name for what the windows of a
  block have in common, one for what they cover together. A common part that is nowhere else ends the search, covers
  that are all alike end it too, and each window of the blocks that are left gets a name of its own.
- Comparison. Windows whose name occurs under two runs are repeated; names meet by key, as neighbours in the order would.

Names are 128 bits (64 of the anchor, 64 of the run or window). No step gathers a name, an anchor or a text's copies in
one task: counts are partial aggregates, and joins have plain shuffles that AQE can split. A text's removed runs are
gathered per distinct text, whose length bounds them.

Defined results: null and empty texts, and texts under 200 bytes, lose nothing; equal texts (and repeated rows) of 200
bytes or more are removed whole, each of them; a very long text is sampled in stretches and shipped in parts, and is whole
only where its bytes are cut; an empty table gives an empty result; further columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trimodel.llm.common import discard, map_batches, prepare, released, stored, texts

GRAM = 32
BASE = 0x9E3779B97F4A7C15
#: Texts are sampled in stretches of so many bytes, overlapping by a window, so that memory is bounded.
STRETCH = 4 << 20
#: Windows in a block of a run; bytes of the parts in which texts are shipped to the runs in them.
BLOCK, PART = 24, 8192


def _grams(b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each 32-byte gram."""
    h, step = b.astype(np.uint64) + np.uint64(1), 1
    while step < GRAM:
        h = h[:-step] * np.uint64(pow(BASE, step, 1 << 64)) + h[step:]
        step *= 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def _least(x: np.ndarray, size: int) -> np.ndarray:
    """The minimum of each `size` neighbours."""
    done = 1
    while done * 2 <= size:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (size - done)], x[size - done :]) if size > done else x


def runs(raw: bytes, starts: np.ndarray, ends: np.ndarray, length: int = 200) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor, of the texts raw[starts:ends] (one behind the other, each of `length` or more):
    first and last window, place of the anchor, hash of its gram."""
    h = _grams(np.frombuffer(raw, dtype=np.uint8))
    best = _least((h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64), length - GRAM + 1)
    anchor = (best & np.uint64(0xFFFFFF)).astype(np.int64)
    new = np.concatenate([[True], anchor[1:] != anchor[:-1]])
    new[starts] = True
    new[(ends - length + 1)[:-1]] = True  # windows from here on reach into the next text
    inside = np.zeros(len(new) + 1, np.int32)
    np.add.at(inside, starts, 1)
    np.add.at(inside, ends - length + 1, -1)
    inside = np.cumsum(inside[:-1]) > 0
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:] - 1, [len(new) - 1]])
    keep = inside[first]
    first, last = first[keep], last[keep]
    return first, last, anchor[first], h[anchor[first]].view(np.int64)


def _key(text: bytes) -> tuple[int, int]:
    import xxhash

    k = xxhash.xxh3_128_intdigest(text)
    return (k >> 64) - (1 << 63), (k & ((1 << 64) - 1)) - (1 << 63)


def _long(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.LongType()) for n in names]


def _int(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.IntegerType()) for n in names]


def _sampled(docs: DataFrame, text_col: str, length: int) -> DataFrame:
    """(k1, k2, s, e, d, anchor, name): text key, first and last window of each run, the anchor's distance from the
    first, the anchor's hash, the run's name."""
    schema = T.StructType([*_long("k1", "k2"), *_int("s", "e", "d"), *_long("anchor", "name")])

    def named(parts: list[tuple[tuple[int, int], int, bytes]]) -> pa.RecordBatch:
        import xxhash

        digest, raw = xxhash.xxh3_64_intdigest, b"".join(p[2] for p in parts)
        ends = np.cumsum([len(p[2]) for p in parts])
        starts = ends - np.array([len(p[2]) for p in parts])
        s, e, a, h = runs(raw, starts, ends, length)
        names = np.fromiter((digest(raw[i:j], k) for i, j, k in zip(s.tolist(), (e + length).tolist(), (a - s).tolist(), strict=True)), np.uint64, len(s))
        own = np.searchsorted(starts, s, side="right") - 1
        k1, k2, move = (np.array(x, np.int64)[own] for x in ([p[0][0] for p in parts], [p[0][1] for p in parts], [p[1] for p in parts] - starts))
        columns = (k1, k2, (s + move).astype(np.int32), (e + move).astype(np.int32), (a - s).astype(np.int32), h, names.view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple[tuple[int, int], int, bytes]] = []
            size = 0
            for t in texts(batch, text_col):
                key = _key(t) if len(t) >= length else None
                for at in range(0, len(t) - length + 1, STRETCH):
                    part = t[at : at + STRETCH + length - 1]
                    if held and size + len(part) > STRETCH:
                        yield named(held)
                        held, size = [], 0
                    held.append((key, at, part))
                    size += len(part)
            if held:
                yield named(held)

    return docs.select(text_col).mapInArrow(released(run), schema)


def _contexts(jobs: DataFrame, docs: DataFrame, text_col: str, length: int) -> DataFrame:
    """jobs (k1, k2, s, e, d, ...) with the bytes from the run's first window to the end of its last, as `bytes`.

    Texts are shipped in parts of PART bytes and what a run may have around, each part of each distinct text once, so
    that neither copies nor long texts count more than their length."""
    around, keys = length, ["k1", "k2", "part"]
    schema = T.StructType([*_long("k1", "k2"), *_int("part"), T.StructField("z", T.BinaryType())])

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press, seen = zstandard.ZstdCompressor(level=1).compress, set()  # of one task's input: its copies go once
        for batch in batches:
            rows = []
            for t in texts(batch, text_col):
                if len(t) < length or (key := _key(t)) in seen:
                    continue
                seen.add(key)
                rows += [(*key, p, press(t[max(0, p * PART - around) : (p + 1) * PART + around])) for p in range(-(-len(t) // PART))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=schema.names)

    parts = docs.where(F.octet_length(text_col) >= length).select(text_col).mapInArrow(released(ship), schema).groupBy(*keys).agg(F.first("z").alias("z"))
    columns = jobs.columns
    listed = jobs.withColumn("part", ((F.col("s") + F.col("d")) / PART).cast("int")).groupBy(*keys).agg(F.collect_list(F.struct(*columns)).alias("jobs"))  # of PART bytes
    out = T.StructType([*jobs.schema.fields, T.StructField("bytes", T.BinaryType())])
    kinds = [_arrow_type(f) for f in out.fields]

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        import zstandard

        expand, found = zstandard.ZstdDecompressor().decompress, batch.column(2)
        flat, sizes = found.flatten(), np.diff(found.offsets.to_numpy())
        s, e = flat.field(columns.index("s")).to_numpy().tolist(), flat.field(columns.index("e")).to_numpy().tolist()
        cuts, at = [], 0
        for part, z, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), sizes.tolist(), strict=True):
            t, base = expand(z), max(0, part * PART - around)
            cuts += [t[i - base : j - base + length] for i, j in zip(s[at : at + n], e[at : at + n], strict=True)]
            at += n
        return pa.RecordBatch.from_arrays([*(c.cast(k) for c, k in zip(flat.flatten(), kinds, strict=False)), pa.array(cuts, pa.binary())], names=out.names)

    joined = parts.join(listed, keys).select("part", "z", "jobs")
    return joined.mapInArrow(_in_slices(cut, 64), out)


def _in_slices(work: Callable[[pa.RecordBatch], pa.RecordBatch], rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """work on a few rows at a time, for what makes many rows of one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, rows):
                if (out := work(b.slice(at, rows))).num_rows:
                    yield out

    return released(run)


def _arrow_type(field: T.StructField) -> pa.DataType:
    return {T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.BooleanType: pa.bool_(), T.BinaryType: pa.binary()}[type(field.dataType)]


def _blocks(named: DataFrame, length: int) -> DataFrame:
    """(k1, k2, s, lo, hi, single, core, hull) for each block of a run: its windows, and names of what all windows of the
    block have in common and of what they cover together (none where the run has a part of the block only). Blocks
    are counted from the anchor, so that those of two runs with the same anchor correspond."""
    most = length - GRAM
    schema = T.StructType([*_long("k1", "k2"), *_int("s", "lo", "hi"), T.StructField("single", T.BooleanType()), *_long("core", "hull")])

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        import xxhash

        digest = xxhash.xxh3_64_intdigest
        col = lambda n: batch.column(batch.schema.get_field_index(n))
        s, e, d, anchor = (col(n).to_numpy().astype(np.int64) for n in ("s", "e", "d", "anchor"))
        a = s + d
        n = d // BLOCK - (a - e) // BLOCK + 1
        own = np.repeat(np.arange(len(s)), n)
        k = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + ((a - e) // BLOCK)[own]
        near, far = BLOCK * k, np.minimum(BLOCK * k + BLOCK - 1, most)
        lo, hi = np.maximum(near, (a - e)[own]), np.minimum(far, d[own])
        raw = col("bytes").to_pylist()
        seed = (anchor[own].view(np.uint64) + k.astype(np.uint64)).tolist()
        i, j = (d[own] - near).tolist(), (d[own] + length - far).tolist()  # from the run's first byte
        core = np.fromiter((digest(raw[o][x:y], z) for o, x, y, z in zip(own.tolist(), i, j, seed, strict=True)), np.uint64, len(own))
        full = (lo == near) & (hi == far)
        i, j = np.maximum(d[own] - far, 0).tolist(), (d[own] - near + length).tolist()
        hull = np.fromiter((digest(raw[o][x:y], z) if f else 0 for o, x, y, z, f in zip(own.tolist(), i, j, k.tolist(), full.tolist(), strict=True)), np.uint64, len(own))
        take = pa.array(own)
        columns = [col("k1").take(take), col("k2").take(take), col("s").take(take), pa.array((a[own] - hi).astype(np.int32)), pa.array((a[own] - lo).astype(np.int32)), col("single").take(take)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(core.view(np.int64)), pa.array(hull.view(np.int64), mask=~full)], names=schema.names)

    return named.mapInArrow(_in_slices(cut, 512), schema)


def _windows(jobs: DataFrame, named: DataFrame, length: int) -> DataFrame:
    """(k1, k2, at, single, core, name) for each window of the blocks in jobs (k1, k2, s, lo, hi, core)."""
    keys = ["k1", "k2", "s"]
    listed = jobs.groupBy(*keys).agg(F.collect_list(F.struct("lo", "hi", "core")).alias("jobs"))  # blocks of one run
    joined = named.select(*keys, "single", "bytes").join(listed, keys)
    schema = T.StructType([*_long("k1", "k2"), *_int("at"), T.StructField("single", T.BooleanType()), *_long("core", "name")])

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        import xxhash

        digest, found = xxhash.xxh3_64_intdigest, batch.column(5)
        flat, sizes = found.flatten(), np.diff(found.offsets.to_numpy())
        lo, hi, core = (flat.field(k).to_numpy().astype(np.int64) for k in range(3))
        row = np.repeat(np.arange(batch.num_rows), sizes)
        own = np.repeat(np.arange(len(lo)), hi - lo + 1)
        at = np.arange(len(own)) - np.repeat(np.cumsum(hi - lo + 1) - (hi - lo + 1), hi - lo + 1) + lo[own]
        raw, row = batch.column(4).to_pylist(), row[own]
        begin = (at - batch.column(2).to_numpy().astype(np.int64)[row]).tolist()
        name = np.fromiter((digest(raw[r][i : i + length]) for r, i in zip(row.tolist(), begin, strict=True)), np.uint64, len(own))
        take = pa.array(row)
        columns = [batch.column(0).take(take), batch.column(1).take(take), pa.array(at.astype(np.int32)), batch.column(3).take(take), pa.array(core[own]), pa.array(name.view(np.int64))]
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    return joined.select(*keys, "single", "bytes", "jobs").mapInArrow(_in_slices(cut, 256), schema)


def repeated_windows(docs: DataFrame, text_col: str = "text", length: int = 200) -> DataFrame:
    """(k1, k2, s, e): for texts by key, runs of windows that start a repeated string. Runs may touch or repeat."""
    spark = docs.sparkSession
    sample = stored(_sampled(docs, text_col, length))
    anchors = sample.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), (F.min("name") != F.max("name")).alias("mixed"))
    anchors = stored(anchors.where("n > 1").select("anchor", "mixed"))
    flagged = stored(sample.join(anchors, "anchor"))
    discard(spark, sample, anchors)
    mixed = flagged.where("mixed")
    named = stored(mixed.groupBy("anchor", "name").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2", "s", "e", "d")).alias("r")))
    twice = named.where("n > 1").select("anchor", "name")
    whole = stored(flagged.where("not mixed").select("k1", "k2", "s", "e").unionByName(mixed.join(twice, ["anchor", "name"]).select("k1", "k2", "s", "e")))
    discard(spark, flagged)
    # Mixed anchors. Blocks of windows whose common part is nowhere else have no repeat; where a block's covers are all
    # alike, all its windows are repeats; only the blocks in between are looked at window by window.
    there = stored(_contexts(named.select("r.*", "anchor", (F.col("n") == 1).alias("single")), docs, text_col, length))
    discard(spark, named)
    blocks = stored(_blocks(there, length))
    cores = blocks.groupBy("core").agg(F.count(F.lit(1)).alias("n"), F.count("hull").alias("full"), F.min("hull").alias("least"), F.max("hull").alias("most"))
    cores = stored(cores.where("n > 1").select("core", ((F.col("full") == F.col("n")) & (F.col("least") == F.col("most"))).alias("alike")))
    shared = stored(blocks.join(cores, "core"))
    discard(spark, blocks, cores)
    alike = shared.where("alike and single").select("k1", "k2", F.col("lo").alias("s"), F.col("hi").alias("e"))
    windows = stored(_windows(shared.where("not alike").select("k1", "k2", "s", "lo", "hi", "core"), there, length))
    discard(spark, there)
    common = stored(windows.groupBy("core", "name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("core", "name"))
    found = windows.where("single").join(common, ["core", "name"]).select("k1", "k2", F.col("at").alias("s"), F.col("at").alias("e"))
    out = stored(whole.unionByName(alike).unionByName(found).distinct())
    discard(spark, whole, shared, windows, common)
    return out


def _shipped(docs: DataFrame, text_col: str, id_cols: list[str]) -> DataFrame:
    """Ids, text key and the compressed text, for a join by the key."""
    rows = docs.select(*[F.col(c) for c in id_cols], F.col(text_col).alias("tm_text"))
    schema = T.StructType([*rows.schema.fields[:-1], *_long("k1", "k2"), T.StructField("z", T.BinaryType())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        import zstandard

        raw, press = texts(batch, "tm_text"), zstandard.ZstdCompressor(level=1).compress
        keys = [_key(t) for t in raw]
        new = [pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array([press(t) for t in raw], pa.binary())]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], names=schema.names)

    return map_batches(rows, run, schema)


def _merged(found: list[dict], length: int) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted((r["s"], r["e"] + length) for r in found):
        if out and s <= out[-1][1]:
            out[-1][1] = max(e, out[-1][1])
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200) -> DataFrame:
    """id, n_bytes, spans (start and end byte of each removed run, flat) and kept (the bytes left) of every row."""
    prepare(docs.sparkSession)
    found = repeated_windows(docs, text_col, length)
    of_text = stored(found.groupBy("k1", "k2").agg(F.collect_list(F.struct("s", "e")).alias("runs")))  # within one text
    joined = _shipped(docs, text_col, [id_col]).join(of_text, ["k1", "k2"], "left").select(F.col(id_col), "z", "runs")
    schema = T.StructType([joined.schema.fields[0], *_long("n_bytes"), T.StructField("spans", T.ArrayType(T.LongType())), T.StructField("kept", T.BinaryType())])

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        import zstandard

        expand, size, spans, kept = zstandard.ZstdDecompressor().decompress, [], [], []
        for z, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            t = expand(z)
            cuts = _merged(found or [], length)
            size.append(len(t))
            spans.append([x for c in cuts for x in c])
            kept.append(b"".join(t[a:b] for a, b in zip([0, *(e for _, e in cuts)], [*(s for s, _ in cuts), len(t)], strict=True)))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(kept, pa.binary())], names=schema.names)

    return map_batches(joined, cut, schema)


def repeats_digest(out: DataFrame, id_col: str = "doc_id") -> DataFrame:
    removed = F.aggregate(F.transform("spans", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)
    return out.select(F.col(id_col), "n_bytes", removed.alias("n_removed"), (F.size("spans") / 2).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts_: list[bytes], length: int = 200) -> list[tuple[int, int, int, str]]:
    """What remove_repeats must give, for small tests."""
    seen: dict[bytes, int] = {}
    for t in texts_:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for t in texts_:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return out
