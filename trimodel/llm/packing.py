"""Best-fit packing of tokenised documents into sequences of bounded length.

Bulk-synchronous best-fit over lengths. Pieces are range-sorted by length over all tasks, and each gets its rank among
the pieces of its length from local ranks and per-task counts (no task gathers a length, however common). A superstep
takes one length, the longest first: a successor sweep over the sorted gaps gives each piece the smallest gap that
holds it, ranks say which piece gets which of the equal gaps, the gaps shrink, and the next length follows. Pieces of
a length are alike and so are gaps of a size, so the sweep works on (size, count) runs. Their number is bounded by
the capacity, not by the data, and only these runs reach the driver. The result is that of best-fit decreasing.

Defined results: a null or empty text is the closing token alone; longer texts than the capacity are cut into full
pieces and a rest; a very long text is encoded in stretches; repeated rows are packed each; ties of length go by
ids_crc32, id and piece; an empty table gives an empty result; further columns aren't read.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trimodel.llm.common import local_ranks, prepare, released, written

#: Words that a worker keeps the ids of, beyond which it starts anew; and bytes that are encoded at a time.
CACHE_WORDS, CACHE_BYTES, STRETCH = 250_000, 8 << 20, 8 << 20

#: Byte classes: white space, letters, other ASCII, the apostrophe, and all else.
SPACE, LETTER, SIGN, QUOTE, OTHER = range(5)
CLASS = np.full(256, OTHER, np.uint8)
CLASS[:128] = SIGN
CLASS[[9, 10, 13, 32]] = SPACE
CLASS[97:123] = LETTER
CLASS[39] = QUOTE
LOWER = bytes(c + 32 if 65 <= c <= 90 else 32 if c in (9, 10, 13) else c for c in range(256))
PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")


class WordEncoder:
    """ids of texts as little-endian unsigned 32-bit bytes, by way of the distinct words of a batch.

    Texts are cut, all at once on their bytes, where the tokenizer's own splitter cuts whatever stands around: at white
    space, between a letter and another ASCII sign, and between such a sign (but an apostrophe) and a letter. Letters are
    a to z and the two-byte ones up to U+00FF; other characters stay with their neighbours. Distinct pieces are encoded
    once; pieces of letters only, which are in lower case and in normal form by then, skip the tokenizer's normaliser and
    splitter. Texts that hold a special token go to the tokenizer whole. The tests compare with encoding whole texts."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        special = self.tokenizer.get_added_tokens_decoder()
        self.special = [t.content.encode() for t in special.values()]
        self.mark, self.mark_id = next(((t.content, i) for i, t in special.items()), (None, None))
        self._forget()

    def _forget(self) -> None:
        self.cache: dict[bytes, int] = {}  # the word's place in starts
        self.starts, self.ids, self.size = np.zeros(1, np.int64), np.zeros(0, np.uint32), 0

    def _alone(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def _letters(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """ids of words of letters, many at a time, and their number for each; a word's last id is one that ends words."""
        lines = [b" ".join(words[k : k + 1024]).decode() for k in range(0, len(words), 1024)]
        found = [np.array(e.ids, np.uint32) for e in self.plain.encode_batch_fast(lines, add_special_tokens=False)]
        ids = np.concatenate(found) if found else np.zeros(0, np.uint32)
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(words):  # a vocabulary without word ends
            each = [self._alone(w.decode()) for w in words]
            return np.concatenate(each), np.array([len(x) for x in each], np.int64)
        return ids, np.diff(cuts, prepend=0)

    def _others(self, words: list[bytes]) -> list[np.ndarray]:
        """ids of other pieces: a special token between them keeps them apart."""
        if self.mark is None:
            return [self._alone(w.decode()) for w in words]
        out: list[np.ndarray] = []
        groups = [[w.decode() for w in words[k : k + 256]] for k in range(0, len(words), 256)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([self.mark.join(g) for g in groups], add_special_tokens=False), strict=True) if groups else ():
            ids = np.array(e.ids, dtype=np.uint32)
            cuts = np.flatnonzero(ids == self.mark_id)
            out += [self._alone(w) for w in group] if len(cuts) != len(group) - 1 else [ids[s:t] for s, t in zip([0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)], strict=True)]
        return out

    def _learn(self, words: list[bytes]) -> None:
        plain, signs, blank = [], [], []
        for w in words:
            (plain if PLAIN.fullmatch(w) else blank if w.isspace() else signs).append(w)
        ids, lengths = self._letters(plain)
        others = self._others(signs)
        first = len(self.starts) - 1
        self.cache.update(zip([*plain, *signs, *blank], range(first, first + len(words)), strict=True))
        lengths = np.concatenate([lengths, [len(x) for x in others], [0] * len(blank)]).astype(np.int64)
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(lengths)])
        self.ids = np.concatenate([self.ids, ids, *others])
        self.size += sum(map(len, words))

    def _encode(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where pieces begin (and the end of all), where their ids begin (likewise), and the ids."""
        low = np.frombuffer(raw.translate(LOWER), np.uint8)
        kind = CLASS[low]
        lead = np.flatnonzero(low[:-1] == 0xC3)
        if len(lead):  # U+00C0 to U+00FF but the two signs among them
            lead = lead[(low[lead + 1] != 0x97) & (low[lead + 1] != 0xB7)]
            kind[lead] = kind[lead + 1] = LETTER
            capital = lead[low[lead + 1] < 0x9F]
            low = low.copy()
            low[capital + 1] |= 0x20
        before, after = kind[:-1], kind[1:]
        cut = ((before == SPACE) != (after == SPACE)) | ((before == LETTER) & ((after == SIGN) | (after == QUOTE))) | ((before == SIGN) & (after == LETTER))
        bounds = np.concatenate([[0], np.flatnonzero(cut) + 1, [len(low)]]).astype(np.int32)
        pieces = pa.BinaryArray.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(low)]).dictionary_encode()
        words = pieces.dictionary.to_pylist()
        if len(self.cache) > CACHE_WORDS or self.size > CACHE_BYTES:
            self._forget()
        if missing := [w for w in words if w not in self.cache]:
            self._learn(missing)
        at = np.fromiter(map(self.cache.__getitem__, words), np.int64, len(words))[pieces.indices.to_numpy(zero_copy_only=False)]
        begin, size = self.starts[at], self.starts[at + 1] - self.starts[at]
        total = np.concatenate([[0], np.cumsum(size)])
        return bounds, total, self.ids[np.repeat(begin - total[:-1], size) + np.arange(total[-1])]

    def encode(self, batch: list[str | None]) -> Iterator[bytes]:
        rows = [(t or "").encode() for t in batch]
        whole = [any(s in r for s in self.special) for r in rows]
        held: list[bytes] = []

        def flush() -> Iterator[bytes]:
            if held:
                bounds, total, ids = self._encode(b" ".join(held))  # a blank between texts is as good as their ends
                ends = np.cumsum([len(r) + 1 for r in held])
                cuts = total[np.searchsorted(bounds, [0, *ends[:-1].tolist(), int(ends[-1]) - 1])]
                for s, t in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    yield ids[s:t].astype("<u4").tobytes()
                held.clear()

        n = 0
        for raw, alone in zip(rows, whole, strict=True):
            if alone or len(raw) > STRETCH or n + len(raw) > STRETCH:
                yield from flush()
                n = 0
            if alone:
                yield self._alone(raw.decode()).astype("<u4").tobytes()
            elif len(raw) > STRETCH:
                yield b"".join(self._encode(part)[2].astype("<u4").tobytes() for part in _stretches(raw))
            else:
                held.append(raw)
                n += len(raw) + 1
        yield from flush()


def _stretches(raw: bytes) -> Iterator[bytes]:
    """A long text cut at blanks into parts of about STRETCH bytes; a part without a blank stays whole."""
    at = 0
    while len(raw) - at > STRETCH:
        end = raw.rfind(b" ", at, at + STRETCH)
        end = raw.find(b" ", at + STRETCH) if end <= at else end
        if end < 0:
            break
        yield raw[at:end]
        at = end
    yield raw[at:]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


PIECES = [("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType())]


def tokenised_pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """id, piece, start, length, ids_crc32 (and ids) of each piece of at most `capacity` tokens."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col), F.col(text_col))
    fields = [rows.schema.fields[0], *[T.StructField(n, t) for n, t in PIECES]] + ([T.StructField("ids", T.ArrayType(T.LongType()))] if with_ids else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), np.array([end_id], dtype="<u4").tobytes()
        for b in batches:
            whole = b.column(1).to_pylist()
            for at in range(0, len(whole), 1024):
                index, piece, start, length, crc, ids = [], [], [], [], [], []
                for k, raw in enumerate(enc.encode(whole[at : at + 1024])):
                    raw += end
                    for p, s in enumerate(range(0, len(raw), 4 * capacity)):
                        part = raw[s : s + 4 * capacity]
                        index.append(at + k)
                        piece.append(p)
                        start.append(s // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            ids.append(np.frombuffer(part, "<u4").astype(np.int64))
                columns = [b.column(0).take(pa.array(index, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(ids, pa.list_(pa.int64()))] if with_ids else []), names=[f.name for f in fields])

    return rows.mapInArrow(released(run), T.StructType(fields))


def best_fit_plan(counts: dict[int, int], capacity: int) -> dict[int, list[tuple[int, int, int, int]]]:
    """length -> runs (first rank, first sequence, pieces a sequence, first offset), by best-fit decreasing.

    gaps maps a gap size to its runs of sequence numbers [first, count]. Pieces of one length that fit a gap several
    times go there several times, as one by one they would: what they leave is the smallest gap that still holds them."""
    gaps: dict[int, list[list[int]]] = {}
    sizes: list[int] = []
    plan: dict[int, list[tuple[int, int, int, int]]] = {}
    opened = 0

    def put(size: int, first: int, count: int) -> None:
        if size not in gaps:
            gaps[size] = []
            insort(sizes, size)
        runs = gaps[size]
        if runs and runs[-1][0] + runs[-1][1] == first:
            runs[-1][1] += count
        else:
            runs.append([first, count])

    for length in sorted(counts, reverse=True):
        left, rank, out = counts[length], 0, plan.setdefault(length, [])
        k = bisect_left(sizes, length)
        taken: list[tuple[int, int, int]] = []
        while left and k < len(sizes):
            size = sizes[k]
            each, runs = size // length, gaps[size]
            while left and runs:
                first, count = runs[-1]
                full = min(count, left // each)
                if full:
                    out.append((rank, first, each, capacity - size))
                    taken.append((size - each * length, first, full))
                    rank, left = rank + full * each, left - full * each
                if full < count and left:  # fewer pieces than this sequence holds
                    out.append((rank, first + full, left, capacity - size))
                    taken.append((size - left * length, first + full, 1))
                    rank, left, full = rank + left, 0, full + 1
                if full == count:
                    runs.pop()
                else:
                    runs[-1] = [first + full, count - full]
            if not runs:
                del gaps[size]
                sizes.pop(k)
            else:
                k += 1
        if left:
            each = capacity // length
            full = left // each
            if full:
                out.append((rank, opened, each, 0))
                taken.append((capacity - each * length, opened, full))
                rank, left, opened = rank + full * each, left - full * each, opened + full
            if left:
                out.append((rank, opened, left, 0))
                taken.append((capacity - left * length, opened, 1))
                opened += 1
        for size, first, count in taken:
            if size:
                put(size, first, count)
    return plan


def packed(pieces: DataFrame, capacity: int = 4096, length_col: str = "length", tie: tuple[str, ...] = ()) -> DataFrame:
    """pieces with sequence_id and offset. tie: further columns to sort by, so that common lengths spread over tasks."""
    spark = pieces.sparkSession
    prepare(spark)
    pieces = written(pieces)
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sorted_ = pieces.withColumn("tm_len", F.col(length_col).cast("int")).repartitionByRange(n, F.col("tm_len").desc(), *tie).sortWithinPartitions(F.col("tm_len").desc(), *tie)
    ranked = local_ranks(sorted_, "tm_len")
    runs = ranked.groupBy("tm_len", "tm_pid").agg(F.count(F.lit(1)).alias("n")).collect()  # at most tasks + capacity rows: the sort keeps lengths together
    before: dict[tuple[int, int], int] = {}
    counts: dict[int, int] = {}
    for r in sorted(runs, key=lambda r: (r.tm_len, r.tm_pid)):
        before[r.tm_len, r.tm_pid] = counts.get(r.tm_len, 0)
        counts[r.tm_len] = counts.get(r.tm_len, 0) + r.n
    if any(x > capacity or x < 1 for x in counts):
        raise ValueError(f"piece lengths must be 1 to {capacity}")
    plan = {k: np.array(v, dtype=np.int64).reshape(-1, 4) for k, v in best_fit_plan(counts, capacity).items()}
    shared, names = spark.sparkContext.broadcast((before, plan)), pieces.columns
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, plan = shared.value
        for b in batches:
            size, pid, rank = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("tm_len", "tm_pid", "tm_rank"))
            sequence, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            key = size * (1 << 32) + pid
            for k in np.unique(key):
                at = np.flatnonzero(key == k)
                length = int(size[at[0]])
                r, p = rank[at] + before[length, int(pid[at[0]])], plan[length]
                q = np.searchsorted(p[:, 0], r, side="right") - 1
                step = r - p[q, 0]
                sequence[at] = p[q, 1] + step // p[q, 2]
                offset[at] = p[q, 3] + step % p[q, 2] * length
            keep = [b.column(b.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence), pa.array(offset)], names=schema.names)

    return ranked.mapInArrow(released(place), schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """A row for each piece: id, piece, start, length, ids_crc32, (ids,) sequence_id, offset."""
    return packed(tokenised_pieces(docs, tokenizer, capacity, end_id, id_col, text_col, with_ids), capacity, "length", ("ids_crc32", id_col, "piece"))
