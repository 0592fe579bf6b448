"""Benchmark decontamination: a broadcast hash set of normalised benchmark n-grams against every token window.

A-Z is lower-cased and words are runs of digits, letters a-z and non-ASCII characters. A window is `n` consecutive words
of an item; an item of fewer words (but not none) is one window of its own length. Words and windows of whole batches are
hashed with numpy on their bytes; each hit is verified by the words themselves.

The hash set's size is known before it is built: its arrays take 32 bytes a word and the text itself. A benchmark whose
set is above `max_broadcast_bytes` is scanned in several passes over the documents, each with a part of the items of about
that size (an item is never cut), and the passes add up to the same result.

Defined results: null and empty texts have no words, so no hits; items without words have no window; equal items are
each counted; an item with a null id marks words but isn't listed; repeated documents are judged alike; a very long text
is hashed in stretches and takes some 30 bytes a word; empty tables give no hits, or an empty result. Columns beside id
and text, whatever their names, are neither read nor, in `remove_contamination`, touched.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trimodel.llm.common import free, map_batches, prepare, texts, written

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Bytes that words are hashed of at a time; powers for the bytes of a word, which start again in longer ones.
STRETCH, POWERS = 2 << 20, 4096
IN_WORD = np.array([48 <= c <= 57 or 97 <= c <= 122 or c >= 128 for c in range(256)])
POWER = np.multiply.accumulate(np.full(POWERS, 0x9E3779B97F4A7C15, np.uint64))


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end of each word of a lower-cased text."""
    parts, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + STRETCH)
        while end < len(raw) and IN_WORD[raw[end]]:  # a word is never cut
            end += 1
        b = np.frombuffer(raw, np.uint8)[at:end]
        edge = np.diff(np.concatenate([[False], IN_WORD[b], [False]]).astype(np.int8))
        s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if len(s):
            size = e - s
            first = np.cumsum(size) - size
            place = np.arange(int(size.sum())) - np.repeat(first, size)
            h = np.add.reduceat((b[IN_WORD[b]].astype(np.uint64) + np.uint64(1)) * POWER[place % POWERS], first)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            parts.append((h ^ h >> np.uint64(32), s + at, e + at))
        at = end
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))


def _joined_words(found: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts behind each other; hash, start, end and owner of each word."""
    raw = b"\n".join(found)
    h, s, e = word_hashes(raw)
    return raw, h, s, e, np.searchsorted(np.cumsum([len(t) + 1 for t in found]), s, side="right")


class WindowSet:
    """Windows by length: sorted hashes with the first word and the item of each, and a table of hash prefixes."""

    def __init__(self, items: list[tuple[str | None, bytes]], n: int):
        self.ids = [i for i, _ in items]
        self.powers = POWER[:n]
        self.raw, h, s, e, owner = _joined_words([t.lower() for _, t in items])
        self.starts, self.ends = s.astype(np.int64), e.astype(np.int64)
        count = np.bincount(owner, minlength=len(items))
        size = np.minimum(n, count)[owner]
        self.windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]] = {}
        for k in np.unique(size).tolist():
            at = np.flatnonzero((size == k)[: len(h) - k + 1] & (owner[: len(h) - k + 1] == owner[k - 1 :]))
            x = self.hash(h, k)[at]
            order = np.argsort(x, kind="stable")
            shift = 64 - max(8, int(8 * len(x)).bit_length())
            table = np.zeros(1 << (64 - shift), bool)
            table[(x >> np.uint64(shift)).astype(np.int64)] = True
            self.windows[k] = x[order], at[order].astype(np.int32), owner[at[order]].astype(np.int32), table, shift

    def hash(self, h: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros(len(h) - size + 1, np.uint64)
        for j in range(size):
            out += h[j : len(h) - size + 1 + j] * self.powers[j]
        return out ^ out >> np.uint64(31)

    def scan(self, docs: list[bytes]) -> list[tuple[list[int], set[int], int]]:
        """For each lower-cased document, maximal hit runs [start, end, start, end, ...] in words, items, and words."""
        raw, h, s, e, owner = _joined_words(docs)
        first = np.searchsorted(owner, np.arange(len(docs) + 1))
        found: list[tuple[list[int], set[int], int]] = [([], set(), n) for n in np.diff(first).tolist()]
        hit = np.zeros(len(h) + 1, dtype=np.int32)
        for size, (hashes, words, item, table, shift) in self.windows.items():
            if len(h) < size:
                continue
            x = self.hash(h, size)
            at = np.flatnonzero(table[(x >> np.uint64(shift)).astype(np.int64)])
            at = at[owner[at] == owner[at + size - 1]]
            low, high = np.searchsorted(hashes, x[at]), np.searchsorted(hashes, x[at], side="right")
            for i, a, b in zip(at[low < high].tolist(), low[low < high].tolist(), high[low < high].tolist(), strict=True):
                mine, true = [raw[p:q] for p, q in zip(s[i : i + size].tolist(), e[i : i + size].tolist(), strict=True)], False
                for w, k in zip(words[a:b].tolist(), item[a:b].tolist(), strict=True):
                    if [self.raw[p:q] for p, q in zip(self.starts[w : w + size].tolist(), self.ends[w : w + size].tolist(), strict=True)] == mine:
                        found[owner[i]][1].add(k)
                        true = True
                if true:
                    hit[i] += 1
                    hit[i + size] -= 1
        if hit.any():
            mask = np.cumsum(hit[:-1]) > 0
            new = np.flatnonzero(mask & np.concatenate([[True], ~mask[:-1] | (owner[1:] != owner[:-1])]))
            stop = np.flatnonzero(mask & np.concatenate([~mask[1:] | (owner[1:] != owner[:-1]), [True]])) + 1
            for a, b in zip(new.tolist(), stop.tolist(), strict=True):
                k = int(owner[a])
                found[k][0].extend((a - int(first[k]), b - int(first[k])))
        return found


def _joined(a: list[int], b: list[int]) -> list[int]:
    """The union of two lists of runs."""
    out: list[list[int]] = []
    for s, e in sorted([*zip(a[::2], a[1::2], strict=True), *zip(b[::2], b[1::2], strict=True)]):
        if out and s <= out[-1][1]:
            out[-1][1] = max(e, out[-1][1])
        else:
            out.append([s, e])
    return [x for run in out for x in run]


def _scanned(docs: DataFrame, benchmark: DataFrame, n: int, text_col: str, item_col: str, item_text: str, max_broadcast_bytes: int) -> tuple[DataFrame, list[str]]:
    """docs with three more columns, and their names: hit runs, items (sorted ids as text), number of words."""
    spark = docs.sparkSession
    prepare(spark)
    items = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(item_text).alias("t"))
    words = F.regexp_count("t", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("t") + 32 * words + 64), F.lit(0))).first()[0]
    passes = max(1, -(-size // max_broadcast_bytes))
    added = free(docs, "tm_runs", "tm_items", "tm_words")
    kinds = (T.ArrayType(T.IntegerType()), T.ArrayType(T.StringType()), T.LongType())
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, k) for c, k in zip(added, kinds, strict=True))])
    out = docs
    for k in range(passes):
        part = items if passes == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(passes)) == k)
        windows = spark.sparkContext.broadcast(WindowSet([(r.i, (r.t or "").encode()) for r in part.collect()], n))

        def scan(batch: pa.RecordBatch, windows=windows, first=k == 0) -> pa.RecordBatch:
            raw, found = [t.lower() for t in texts(batch, text_col)], []
            at = 0
            while at < len(raw):  # a few megabytes at a time, or one text
                end, total = at + 1, len(raw[at])
                while end < len(raw) and total + len(raw[end]) <= STRETCH:
                    total += len(raw[end])
                    end += 1
                found += windows.value.scan(raw[at:end])
                at = end
            runs, ids = [f[0] for f in found], [{i for x in f[1] if (i := windows.value.ids[x]) is not None} for f in found]
            kept = batch.columns
            if not first:
                runs = [_joined(a, b) for a, b in zip(batch.column(len(kept) - 3).to_pylist(), runs, strict=True)]
                ids = [{*a, *b} for a, b in zip(batch.column(len(kept) - 2).to_pylist(), ids, strict=True)]
                kept = kept[:-3]
            more = [pa.array(runs, pa.list_(pa.int32())), pa.array([sorted(x) for x in ids], pa.list_(pa.string())), pa.array([f[2] for f in found], pa.int64())]
            return pa.RecordBatch.from_arrays([*kept, *more], names=schema.names)

        out = map_batches(out, scan, schema)
        if k < passes - 1:
            out = written(out)  # one pass's set in memory at a time
    return out, added


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", max_broadcast_bytes: int = 192 << 20) -> DataFrame:
    """Of each document: id, n_words, hit runs (start and end word of each, flat) and the ids of the items that occur."""
    rows = docs.select(F.col(id_col), F.col(text_col))
    out, (runs, ids, words) = _scanned(rows, benchmark, n, text_col, item_col, item_text, max_broadcast_bytes)
    return out.select(F.col(id_col), F.col(words).alias("n_words"), F.col(runs).alias("runs"), F.col(ids).alias("items"))


def contamination_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    n_hit = F.aggregate(F.transform("runs", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select(F.col(id_col), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("runs") > 0).alias("contaminated"))


def remove_contamination(docs: DataFrame, benchmark: DataFrame, mode: str = "spans", n: int = 10, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", max_broadcast_bytes: int = 192 << 20) -> DataFrame:
    """docs without its hits, same columns. mode `spans`: from the first to the last word of each hit run is cut, and a
    document that has no word left goes; mode `documents`: every document with a hit goes. Others stay as they are."""
    out, (runs_, _, _) = _scanned(docs, benchmark, n, text_col, item_col, item_text, max_broadcast_bytes)
    if mode == "documents":
        return out.where(F.size(runs_) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
    if mode != "spans":
        raise ValueError(f"unknown mode {mode!r}")
    names = docs.columns
    at = names.index(text_col)

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        runs, count = batch.column(batch.num_columns - 3).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
        old, new, keep = batch.column(at).to_pylist(), [], []
        for text, r, words in zip(old, runs, count, strict=True):
            if not r:
                new.append(text)
                keep.append(True)
                continue
            raw = text.encode()
            spans = [m.span() for m in WORD.finditer(raw.lower())]
            parts, last = [], 0
            for s, e in zip(r[::2], r[1::2], strict=True):
                parts.append(raw[last : spans[s][0]])
                last = spans[e - 1][1]
            new.append(b"".join([*parts, raw[last:]]).decode())
            keep.append(sum(e - s for s, e in zip(r[::2], r[1::2], strict=True)) < words)
        columns = [*batch.columns[:at], pa.array(new, pa.string()), *batch.columns[at + 1 : -3]]
        return pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep))

    return map_batches(out, cut, docs.schema)


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g, least(10, len(w)) AS n
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
hits AS (SELECT x.doc_id, x.i, x.n, bw.item_id FROM (
           SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
           FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)) x JOIN bw ON bw.g = x.g AND bw.n = x.n),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM hits) GROUP BY 1)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
