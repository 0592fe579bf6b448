"""Substring dedup over sliding sentence spans.

A text is cut into sentences after `.`, `!` or `?` with white space behind, and at line ends; what has fewer than
`least` words (three) is no sentence of its own and goes on to the next end, as initials, numbers and cells of tables do.
The pieces join to the whole text again. A sentence is compared lower-cased, with white space runs as one blank and outer
white space gone; pieces without a letter or digit belong to no sentence and stay.

Every run of `span` consecutive sentences (three) is hashed (128 bits). The hashes meet globally, and of the occurrences
of a run all but the first (by id, then text hash, then place) count as repeats: their sentences are removed. A longer
repeated span is the union of its runs of three, so spans of every length are covered. What is a repeat is judged on the
input, not on what is left.

Passages with fewer whole sentences in them, as those that begin and end inside sentences, are found by their words
(lower-cased, between white space): of each `choice` windows of `window` words that follow each other (25 of 26) the one
with the least hash is a span too, and all occurrences but the first lose its words. Equal passages of 50 words or more
have such a span in common, wherever they stand; what a passage has before its first and behind its last span stays. A
span that holds `span` sentences that go adds nothing; in one text, spans that overlap the first occurrence stay.

A run's hash may be as common as you like: its first place is a minimum by partial aggregation, the runs that occur once
drop out, and the join back has plain shuffles on both sides, which AQE can split. Runs and spans of words go one after
the other, so that their tables don't add up.

Defined results: null and empty texts, and texts of fewer sentences than a span and fewer words than a window, lose nothing; the rest of a text behind
its last sentence counts as one, however short; texts with equal ids and contents are one text listed twice and judged
alike; a null id comes before all others; ties between equal ids go by text hash; an empty table gives an empty result;
a very long text is held by one task as a whole, with its sentences; further columns aren't read, and
`drop_repeated_spans` leaves them as they are, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trimodel.llm.common import discard, free, map_batches, prepare, stored, texts

#: What ends a piece of text, with the white space behind.
END = re.compile(r"[.!?]+(?=\s)[^\S\n]*\n?|\n")
ALNUM = re.compile(r"[^\W_]")
WORD = re.compile(r"\S+")


def sentences(text: str, least: int = 3) -> Iterator[tuple[str, str]]:
    """(piece, what is compared; empty if it is no sentence). The pieces join to the text."""
    start = at = 0
    words: list[str] = []
    for end in (*(m.end() for m in END.finditer(text)), len(text)):
        piece, at = text[at:end], end
        if ALNUM.search(piece):
            words += piece.lower().split()
        if words and (len(words) >= least or end == len(text)):
            yield text[start:end], " ".join(words)
            start, words = end, []
        elif not words and end > start:
            yield text[start:end], ""
            start = end


def _runs(text: str, span: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Place and hash (h1, h2) of the run of `span` sentences from each sentence on."""
    import xxhash

    digest = [xxhash.xxh3_128_digest(c.encode()) for _, c in sentences(text, least) if c]
    line = b"".join(digest)
    names = b"".join([xxhash.xxh3_128_digest(line[i : i + 16 * span]) for i in range(0, 16 * (len(digest) - span + 1), 16)])
    h = np.frombuffer(names, dtype=">i8").astype(np.int64).reshape(-1, 2)
    return np.arange(len(h)), h


def _passages(text: str, window: int, choice: int) -> tuple[np.ndarray, np.ndarray]:
    """Place (in words) and hash (h1, h2) of the chosen windows of words."""
    import xxhash

    words = text.lower().split()
    n = len(words) - window + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros((0, 2), np.int64)
    digest = xxhash.xxh3_64_intdigest
    a = np.fromiter((digest(w) for w in words), np.uint64, len(words))
    h = np.zeros(n, np.uint64)
    for k in range(window):
        h = h * np.uint64(0x9E3779B97F4A7C15) + a[k : k + n]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    least = np.lib.stride_tricks.sliding_window_view(h, min(choice, n)).argmin(axis=1)
    at = np.unique(least + np.arange(len(least)))
    line = a.tobytes()
    names = b"".join([xxhash.xxh3_128_digest(line[8 * i : 8 * (i + window)]) for i in at.tolist()])
    return at, np.frombuffer(names, dtype=">i8").astype(np.int64).reshape(-1, 2)


def text_key(column: str) -> F.Column:
    return F.xxhash64(F.coalesce(F.col(column), F.lit("")), F.octet_length(column))


def _repeats(rows: DataFrame, hashed: Callable[[str], tuple[np.ndarray, np.ndarray]], apart: int) -> DataFrame:
    """A written table (id, tm_key, at): occurrences of what is hashed, but the first and those of the same text that
    are less than `apart` behind it. rows: id, tm_key, tm_text."""
    schema = T.StructType([*rows.schema.fields[:2], T.StructField("at", T.IntegerType()), T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [hashed(t.decode()) for t in texts(batch, "tm_text")]
        size = [len(h) for _, h in found]
        owner, at, h = pa.array(np.repeat(np.arange(len(found)), size)), np.concatenate([x.astype(np.int32) for x, _ in found]), np.concatenate([h for _, h in found])
        return pa.RecordBatch.from_arrays([batch.column(0).take(owner), batch.column(1).take(owner), pa.array(at), pa.array(h[:, 0]), pa.array(h[:, 1])], names=schema.names)

    spans = stored(map_batches(rows, run, schema))
    firsts = stored(spans.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("many"), F.min(F.struct("id", "tm_key", "at")).alias("first")).where("many > 1").drop("many"))
    discard(rows.sparkSession)  # the shuffle of the counts, before that of the join
    same = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("tm_key") == F.col("first.tm_key"))
    out = stored(spans.join(firsts, ["h1", "h2"]).where(~same | (F.col("at") >= F.col("first.at") + apart)).select("id", "tm_key", "at").distinct())
    discard(rows.sparkSession, spans, firsts)
    return out


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = 3, least: int = 3, window: int = 26, choice: int = 25) -> DataFrame:
    """(id, tm_key, spans, passages): for documents by id and text hash, the first sentences of their non-first repeated
    runs, and the first words of their non-first repeated spans of words."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), text_key(text_col).alias("tm_key"), F.col(text_col).alias("tm_text"))
    runs = _repeats(rows, lambda t: _runs(t, span, least), 1)
    words = _repeats(rows, lambda t: _passages(t, window, choice), window)
    both = runs.select("id", "tm_key", F.col("at").alias("s"), F.lit(None).cast("int").alias("w")).unionByName(words.select("id", "tm_key", F.lit(None).cast("int").alias("s"), F.col("at").alias("w")))
    out = stored(both.groupBy("id", "tm_key").agg(F.collect_list("s").alias("spans"), F.collect_list("w").alias("passages")))  # within one text
    discard(docs.sparkSession, runs, words)
    return out


def _cut(text: str, starts: list[int], passages: list[int], span: int, least: int, window: int) -> tuple[str, int, int]:
    """The text without the sentences of the runs and the words of the passages; its sentences; those that lost words."""
    gone = {i for s in starts for i in range(s, s + span)}
    pieces = list(sentences(text, least))
    ends = np.cumsum([len(p.split()) for p, _ in pieces])
    lost = np.zeros(ends[-1], bool)
    if passages:
        goes = np.zeros(len(pieces), bool)
        goes[np.flatnonzero([bool(c) for _, c in pieces])[sorted(gone)]] = True
        first, end = np.r_[0, ends[:-1]][goes], ends[goes]
        for p in passages:
            if np.searchsorted(end, p + window, "right") - np.searchsorted(first, p) < span:
                lost[p : p + window] = True
    out, at, removed = [], 0, 0
    for (piece, compared), end in zip(pieces, ends.tolist(), strict=True):
        if not compared:
            out.append(piece)
            continue
        if at in gone:
            removed += 1
        elif (drop := lost[end - len(piece.split()) : end]).any():
            removed += 1
            if not drop.all():
                words = [m.span() for m in WORD.finditer(piece)]
                follows = [*(s for s, _ in words[1:]), len(piece)]
                out.append(piece[: words[0][0]])
                out += [piece[s:f] for (s, _), f, x in zip(words, follows, drop.tolist(), strict=True) if not x]
                if drop[-1]:
                    out.append(piece[words[-1][1] :])
        else:
            out.append(piece)
        at += 1
    return "".join(out), at, removed


def drop_repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = 3, least: int = 3, counts: bool = False, window: int = 26, choice: int = 25) -> DataFrame:
    """docs, same columns, with texts that lost their repeated sentences and passages; counts adds tm_sentences and
    tm_removed, the sentences that lost all or some words (or these names with a number behind, where docs has them)."""
    found = repeated_spans(docs, id_col, text_col, span, least, window, choice)
    key, own_id, own_key, starts, passages = free(docs, "tm_key", "tm_id", "tm_id_key", "tm_spans", "tm_passages")
    found = found.select(F.col("id").alias(own_id), F.col("tm_key").alias(own_key), F.col("spans").alias(starts), F.col("passages").alias(passages))
    keyed = docs.withColumn(key, text_key(text_col))
    joined = keyed.join(found, F.col(id_col).eqNullSafe(F.col(own_id)) & (F.col(key) == F.col(own_key)), "left").select(*[F.col(f"`{c}`") for c in docs.columns], starts, passages)
    fields = [*docs.schema.fields, *([T.StructField(n, T.LongType()) for n in free(docs, "tm_sentences", "tm_removed")] if counts else [])]
    at = docs.columns.index(text_col)
    names = [f.name for f in fields]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        text, n, gone = [], [], []
        for t, first, words in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
            if first or words:
                kept, sentences_, removed = _cut(t, first, words, span, least, window)
            else:
                kept, sentences_, removed = t, sum(1 for _, c in sentences(t or "", least) if c) if counts else 0, 0
            text.append(kept)
            n.append(sentences_)
            gone.append(removed)
        columns = [*batch.columns[:at], pa.array(text, pa.string()), *batch.columns[at + 1 : -2]]
        return pa.RecordBatch.from_arrays(columns + ([pa.array(n, pa.int64()), pa.array(gone, pa.int64())] if counts else []), names=names)

    return map_batches(joined, run, T.StructType(fields))


def span_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = 3, least: int = 3) -> DataFrame:
    """id, n_sentences, n_removed (sentences that lost all or some words) and kept_sha256 (of the text that is left) of every row."""
    out = drop_repeated_spans(docs.select(id_col, text_col), id_col, text_col, span, least, counts=True)
    return out.select(F.col(id_col), F.col("tm_sentences").alias("n_sentences"), F.col("tm_removed").alias("n_removed"), F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256).alias("kept_sha256"))
