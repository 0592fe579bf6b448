"""SimHash near-duplicates by a Gray-order hierarchical index.

Fingerprints are 64 bits over XXH64 (seed 42) of word shingles. Distinct fingerprints, not documents, are indexed, so a
group of copies is one entry. The index is a hierarchy of masked bit patterns:

- The upper nodes are masks of two of four 16-bit blocks. Two fingerprints that differ in at most two bits agree in at
  least one of the six masks, so each upper node (mask, pattern) is searched by itself and the shuffle is by node.
- A node with more than `node_size` fingerprints gets children: the 32 free bits are cut into four blocks of eight, and
  again two of them are masked. A child has 16 free bits, so it never holds more than 65,536 fingerprints.
- Inside a node, fingerprints are sorted by the Gray rank of their bits. Blocks of 16 neighbours share most bits; the
  shared ones are factored out as a mask and a pattern, in levels up to the node's root. A search accumulates the
  differences to the shared bits and prunes a whole group as soon as they exceed the threshold.

Links of a node are handed on as a spanning forest, and components come from distributed star contraction.

Defined results: a null or empty text, or one of white space, has fingerprint zero and links like any other; fewer
words than a shingle make one shingle; copies and repeated rows share a fingerprint; a null id is ignored when
components get their smallest id (a component of null ids only has a null one); a very long text is held with its words
and hashes by one task; an empty table gives an empty result; further columns, whatever their names, aren't read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from trimodel.llm.common import EDGES, _forest, bucketed, components, discard, free, map_batches, prepare, released, sieved, stored, texts, written

WORD = re.compile(rb"[^\x20\x09-\x0d]+")
U1 = np.uint64(1)


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The 64-bit SimHash of a text, as an unsigned number."""
    import xxhash

    words = WORD.findall(text.lower())
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])
    k = min(shingle, len(words))
    spans = zip(starts[: len(words) - k + 1].tolist(), (ends[k - 1 :] - 1).tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    n = len(words) - k + 1
    return majority(np.fromiter((digest(line[s:e], 42) for s, e in spans), dtype=np.uint64, count=n))


def majority(h: np.ndarray) -> int:
    """Each bit is 1 if it is in over half the hashes; 0 for none."""
    total, n = np.zeros(64, dtype=np.int64), len(h)
    for s in range(0, n, 1 << 16):
        bits = np.unpackbits(h[s : s + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        total += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(total * 2 > n).view(">u8")[0])


def with_fingerprints(docs: DataFrame, text_col: str = "text", name: str = "tm_fp", shingle: int = 3) -> DataFrame:
    """docs with the fingerprint as a signed long."""
    prepare(docs.sparkSession)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())])
    names = schema.names

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.array([fingerprint(t, shingle) for t in texts(batch, text_col)], dtype=np.uint64)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(fp.view(np.int64))], names=names)

    return map_batches(docs, run, schema)


def _bits(width: int, blocks: int) -> list[int]:
    """Masks of two of the `blocks` equal blocks of the lowest `width` bits."""
    size = width // blocks
    block = [((1 << size) - 1) << (size * k) for k in range(blocks)]
    return [a | b for a, b in combinations(block, 2)]


MASKS = _bits(64, 4)


def _spread(value: np.ndarray, mask: int) -> np.ndarray:
    """The bits of value at the ones of mask, next to each other (mask: whole bytes)."""
    out, at = np.zeros_like(value), 0
    for byte in range(8):
        if mask >> (8 * byte) & 255:
            out |= (value >> np.uint64(8 * byte) & np.uint64(255)) << np.uint64(at)
            at += 8
    return out


def children() -> list[tuple[int, int]]:
    """For each upper mask, masks of two of the four bytes it leaves free: 36 (upper, child) pairs."""
    out = []
    for m in MASKS:
        free = [b for b in range(8) if not m >> (8 * b) & 255]
        out += [(m, 255 << 8 * a | 255 << 8 * b) for a, b in combinations(free, 2)]
    return out


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The position of each number in the reflected Gray order."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


def search(fps: np.ndarray, most: int = 2, fan: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b) of distinct fingerprints of one node at `most` differing bits or fewer, as index arrays."""
    x = fps[np.argsort(gray_rank(fps), kind="stable")]
    levels: list[tuple[np.ndarray, np.ndarray]] = [(x, np.full(len(x), ~np.uint64(0)))]
    while len(levels[-1][0]) > fan:
        pattern, mask = levels[-1]
        starts = np.arange(0, len(pattern), fan)
        same = np.bitwise_and.reduceat(mask, starts) & ~(np.bitwise_or.reduceat(pattern, starts) ^ np.bitwise_and.reduceat(pattern, starts))
        levels.append((pattern[starts] & same, same))
    rows, found_a, found_b = 4096, [], []
    for s in range(0, len(x), rows):  # queries in blocks: bounded memory
        q = np.arange(s, min(s + rows, len(x)))
        top = levels[-1]
        qi, node = np.repeat(q, len(top[0])), np.tile(np.arange(len(top[0])), len(q))
        for depth in range(len(levels) - 1, -1, -1):
            pattern, mask = levels[depth]
            near = np.bitwise_count((x[qi] ^ pattern[node]) & mask[node]) <= most
            near &= (node + 1) * fan**depth > qi + 1  # pairs once: only nodes that reach beyond the query
            qi, node = qi[near], node[near]
            if depth:
                below = len(levels[depth - 1][0])
                kids = (node[:, None] * fan + np.arange(fan)).ravel()
                qi = np.repeat(qi, fan)
                inside = kids < below
                qi, node = qi[inside], kids[inside]
        found_a.append(x[qi])
        found_b.append(x[node])
    return (np.concatenate(found_a), np.concatenate(found_b)) if found_a else (x[:0], x[:0])


def _linked(nodes: DataFrame, most: int) -> DataFrame:
    """Star edges of each node's links. nodes: (mask int, key long, fp long), dealt by (mask, key) and sorted so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: np.ndarray = np.zeros((3, 0), np.int64)

        def solve(part: np.ndarray) -> pa.RecordBatch | None:
            new = np.flatnonzero(np.any(part[:2, 1:] != part[:2, :-1], axis=0)) + 1
            starts, ends = np.concatenate([[0], new]), np.concatenate([new, [part.shape[1]]])
            a_all, b_all = [], []
            several = ends - starts > 1
            pair = ends - starts == 2
            a, b = part[2, starts[pair]], part[2, starts[pair] + 1]
            near = np.bitwise_count((a ^ b).view(np.uint64)) <= most
            a_all.append(a[near])
            b_all.append(b[near])
            for s, e in zip(starts[several & ~pair].tolist(), ends[several & ~pair].tolist(), strict=True):
                a, b = search(part[2, s:e].astype(np.int64).view(np.uint64), most)
                a_all.append(a.view(np.int64))
                b_all.append(b.view(np.int64))
            a, b = np.concatenate(a_all), np.concatenate(b_all)
            if not len(a):
                return None
            hi, lo = _forest(a, b)
            return pa.RecordBatch.from_arrays([pa.array(hi), pa.array(lo)], names=["hi", "lo"])

        for batch in batches:
            part = np.concatenate([rest, np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)])], axis=1)
            last = part[:2, -1]
            whole = part.shape[1] - int(np.argmin(np.append(np.all(part[:2, ::-1] == last[:, None], axis=0), False)))
            rest = part[:, whole:]  # the last node may go on in the next batch
            if whole and (out := solve(np.ascontiguousarray(part[:, :whole]))) is not None:
                yield out
        if rest.shape[1] and (out := solve(np.ascontiguousarray(rest))) is not None:
            yield out

    return nodes.mapInArrow(released(run), EDGES)


def fingerprint_links(distinct: DataFrame, most: int = 2, node_size: int = 2_000) -> DataFrame:
    """Edges (hi, lo) that connect the distinct fingerprints `fp` as their links do."""
    if not 0 <= most <= 2:
        raise ValueError("the masks find links of 0 to 2 differing bits")
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    upper = F.explode(F.array(*[F.struct(F.lit(k).alias("mask"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key"), F.col("fp")) for k, m in enumerate(MASKS)])).alias("n")
    nodes = distinct.select(upper).select("n.*")
    big = written(nodes.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > node_size).select("mask", "key"))
    if big.limit(1).count():
        on = ["mask", "key"]
        small, large = nodes.join(big, on, "left_anti"), nodes.join(big, on, "left_semi")
        all_kids = children()
        kids = [F.when(F.col("mask") == MASKS.index(m), F.struct(F.lit(6 + k).alias("mask"), F.col("fp").bitwiseAND(F.lit(signed(m | c))).alias("key"), F.col("fp"))) for k, (m, c) in enumerate(all_kids)]
        parts = large.select(F.explode(F.filter(F.array(*kids), lambda x: x.isNotNull())).alias("n")).select("n.*")
        nodes = small.unionByName(parts)
    dealt = nodes.repartition("mask", "key").sortWithinPartitions("mask", "key")
    return _linked(dealt, most)


def classes(fps: DataFrame, id_col: str, fp_col: str = "tm_fp", most: int = 2, node_size: int = 2_000) -> DataFrame:
    """A written table (fp, root, component_id): each distinct fingerprint's component and the smallest id in it."""
    least = written(fps.groupBy(F.col(fp_col).alias("fp")).agg(F.min(id_col).alias("id")))
    roots = components(fingerprint_links(least.select("fp"), most, node_size))
    joined = least.join(roots, least.fp == roots.node, "left").select("fp", "id", F.coalesce("root", "fp").alias("root"))
    joined = written(joined)
    smallest = written(joined.groupBy("root").agg(F.min("id").alias("component_id")))
    out = written(joined.select("fp", "root").join(smallest, "root").select("fp", "root", "component_id"))
    discard(fps.sparkSession, least, roots, joined, smallest)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, most: int = 2) -> DataFrame:
    """id, fingerprint (16 hex digits) and component_id of every row."""
    fps = written(with_fingerprints(docs.select(F.col(id_col), F.col(text_col).alias("tm_text")), "tm_text", "tm_fp", shingle).drop("tm_text"))
    found = classes(fps, id_col, "tm_fp", most)
    return fps.join(found, fps.tm_fp == found.fp, "left").select(F.col(id_col), F.lower(F.lpad(F.hex("tm_fp"), 16, "0")).alias("fingerprint"), "component_id")


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, most: int = 2) -> DataFrame:
    """docs, same columns, with one document of each component: the one with the smallest id. Where rows share that id,
    the one with the smallest fingerprint stays, and of equal rows one."""
    (fp,) = free(docs, "tm_fp")
    fps = with_fingerprints(docs, text_col, fp, shingle)
    ids = written(fps.select(F.col(id_col).alias("tm_id"), F.col(fp).alias("tm_fp")))
    return _first_of_each(docs, fps, fp, ids, classes(ids, "tm_id", "tm_fp", most), id_col)


def _first_of_each(docs: DataFrame, fps: DataFrame, fp: str, ids: DataFrame, found: DataFrame, id_col: str) -> DataFrame:
    """fps: docs with the fingerprint fp; ids: (tm_id, tm_fp) of all rows; found: (fp, root, component_id)."""
    judged = ids.join(found, ids.tm_fp == found.fp, "left")
    stays = F.col("tm_id").eqNullSafe(F.col("component_id"))
    first = judged.where(stays)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    own, keep, least = free(fps, "tm_id", "tm_keep", "tm_least")
    if not ids.groupBy("tm_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        # Rows stay where they are, unless they may be among those that go: only such rows meet the ids that stay.
        gone = written(judged.where(~stays).select("tm_id"))
        kept, _ = sieved(first.select(F.col("tm_id").alias(own)), [own], gone)
        open_, sure = sieved(docs, [id_col], gone)
        kept = written(kept)
        return sure.unionByName(open_.join(kept, F.col(id_col).eqNullSafe(F.col(own)), "left_semi")).select(*columns)
    # Ids repeat: the fingerprint tells rows of one id apart.
    best = written(first.groupBy("root").agg(F.min("tm_fp").alias(keep), F.min("component_id").alias(least)).drop("root"))
    kept = fps.join(best, F.col(fp).eqNullSafe(F.col(keep)) & F.col(id_col).eqNullSafe(F.col(least)))
    return kept.dropDuplicates([id_col, fp]).select(*columns)


# Similar texts: candidates by prefixes of shingle sets, links by their exact Jaccard similarity.


def shingle_set(text: bytes, shingle: int = 5) -> np.ndarray:
    """The distinct word shingles of a text as sorted 64-bit hashes."""
    import xxhash

    found = WORD.findall(text.lower())
    if not found:
        return np.zeros(0, np.int64)
    line = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found])
    starts = np.concatenate([[0], ends[:-1]])
    k = min(shingle, len(found))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(found) - k + 1].tolist(), (ends[k - 1 :] - 1).tolist(), strict=True)
    return np.unique(np.fromiter((digest(line[s:e], 42) for s, e in spans), np.uint64, len(found) - k + 1).view(np.int64))


def _set_key(found: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63)


#: Slack for sizes times a similarity that isn't a binary fraction.
TINY = 1e-9


def _common(texts_: DataFrame, shingle: int, most: int = 1 << 17, block: int = 2_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several texts have, sorted, and in how many; every text counts. They only choose the order of
    shingles: any order finds every pair, one with the common shingles last has fewer candidates. texts_: fp, text.

    A task keeps `most` counts (Misra and Gries): beyond them, all counts fall by the least, by no more than a `most`-th
    of the task's shingles in all. So what a task has few of goes, and no count is too high; with fewer distinct shingles
    a task, all are exact. The 500,000 highest sums reach the driver."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        held: list[np.ndarray] = []

        def count() -> None:
            nonlocal h, n
            every = np.concatenate([h, *held])
            weight = np.concatenate([n, np.ones(len(every) - len(h), np.int64)])
            h, at = np.unique(every, return_inverse=True)
            n = np.bincount(at, weight, len(h)).astype(np.int64)
            if len(n) > most:
                n -= np.partition(n, len(n) - most - 1)[len(n) - most - 1]
                h, n = h[n > 0], n[n > 0]
            held.clear()

        waiting = 0
        for b in batches:
            for t in texts(b, "text"):
                held.append(shingle_set(t, shingle))
                waiting += len(held[-1])
                if waiting >= block:
                    count()
                    waiting = 0
        count()
        yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], names=["h", "n"])

    seen = texts_.mapInArrow(released(each), "h long, n long")
    rows = seen.groupBy("h").agg(F.sum("n").alias("n")).where("n > 2").orderBy(F.desc("n"), "h").limit(500_000).toArrow()
    h, n = rows.column("h").to_numpy(), rows.column("n").to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def _lists(texts_: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """A written table (h, fp, size, at, n): the shingles of each text up to where one of every similar text's must have come,
    rarest first, if n > 1 texts have them there; at is the place in this order. texts_: fp, text.

    One exchange by h both counts and deals: a list of any length is sorted, and spilled, by one task."""
    common, counts = _common(texts_, shingle)
    # Through the driver's broadcast, once for each executor.
    shared = texts_.sparkSession.sparkContext.broadcast((common, counts))
    schema = T.StructType([T.StructField("h", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("size", T.IntegerType()), T.StructField("at", T.IntegerType())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        often, n = shared.value
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(4)]
        for fp, t in zip(batch.column(0).to_pylist(), texts(batch, "text"), strict=True):
            s = shingle_set(t, shingle)
            if not len(s):
                continue
            weight = np.zeros(len(s), np.int64)
            if len(often):
                place = np.minimum(np.searchsorted(often, s), len(often) - 1)
                weight = np.where(often[place] == s, n[place], 0)
            size = len(s) - int(np.ceil(similarity * len(s) - TINY)) + 1
            first = s[np.lexsort((s, weight))[:size]]
            for held, x in zip(out, (first, np.full(len(first), fp), np.full(len(first), len(s)), np.arange(len(first))), strict=True):
                held.append(x)
        columns = [np.concatenate(x) for x in out]
        return pa.RecordBatch.from_arrays([pa.array(columns[k].astype(np.int64 if k < 2 else np.int32)) for k in range(4)], names=schema.names)

    of_list = F.count(F.lit(1)).over(Window.partitionBy("h"))
    out = stored(map_batches(texts_, run, schema).withColumn("n", of_list).where("n > 1"))
    shared.destroy()
    return out


def _verified(pairs: DataFrame, texts_: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """A written table: of the pairs (a, b), those whose shingle sets are similar, as edges. texts_: fp, text (bucketed).

    The texts of the b, of which there are few where a crowd meets one of them, are put aside; those of the a travel to
    them by a join with shuffles on both sides, which AQE splits where one b has many."""
    pairs = stored(pairs)
    first = texts_.select(F.col("fp").alias("a"), F.col("text").alias("ta"))
    second = stored(pairs.select(F.col("b").alias("fp")).distinct().join(texts_, "fp").select(F.col("fp").alias("b"), F.col("text").alias("tb")))
    both = pairs.join(first, "a").join(second, "b").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int | None, np.ndarray] = (None, np.zeros(0, np.int64))
        for batch in batches:
            hi, lo = [], []
            for a, b, s, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch, "ta"), texts(batch, "tb"), strict=True):
                if held[0] != b:  # a join leaves equal b next to each other
                    held = b, shingle_set(t, shingle)
                x = shingle_set(s, shingle)
                same = len(np.intersect1d(x, held[1], assume_unique=True))
                if same >= similarity * (len(x) + len(held[1]) - same) - TINY:
                    hi.append(max(a, b))
                    lo.append(min(a, b))
            if hi:
                yield pa.RecordBatch.from_arrays([pa.array(hi, pa.int64()), pa.array(lo, pa.int64())], names=["hi", "lo"])

    out = stored(both.mapInArrow(released(run), EDGES))
    discard(pairs.sparkSession, pairs, second)
    return out


def _copies(state: DataFrame, most: int) -> DataFrame:
    """Pairs (a, b) that SimHash alone proposes: texts of one fingerprint, and of fingerprints that the index links.
    state: fp, sim (written)."""
    least = stored(state.groupBy("sim").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")))
    same = state.join(least.where("n > 1"), "sim").where("fp <> b").select(F.col("fp").alias("a"), "b")
    linked = stored(fingerprint_links(least.select(F.col("sim").alias("fp")), most))
    one, two = least.select(F.col("sim").alias("hi"), F.col("b").alias("a")), least.select(F.col("sim").alias("lo"), "b")
    return same.unionByName(linked.join(one, "hi").join(two, "lo").select("a", "b"))


def similar_links(texts_: DataFrame, state: DataFrame, similarity: float = 0.8, shingle: int = 5, rounds: int = 3, most: int = 2, far: int = 22, early: int = 6) -> DataFrame:
    """Edges (hi, lo) that connect texts of distinct shingle sets as all their links do.

    texts_: fp, text (bucketed by fp); state: fp, sim (written). What SimHash proposes by the index is verified first, so
    that copies with few changes are one component before any list of a shingle is looked at."""
    spark = texts_.sparkSession
    lists = _lists(texts_, similarity, shingle)
    discard(spark)
    # Of the shingles that two similar texts share, before the first none is shared, so that the rest of the shorter
    # bounds what they have in common. And their SimHashes, which differ in 15 % of the bits where the similarity is 0.8
    # and in half of them where nothing is shared, are not further apart than `far`.
    small, large = F.least("z", "s"), F.greatest("z", "s")
    rest = F.least(F.col("z") - F.col("p"), F.col("s") - F.col("t"))
    may = (small >= similarity * large - TINY) & (rest >= similarity / (1 + similarity) * (F.col("z") + F.col("s")) - TINY)
    apart = F.bit_count(F.col("y").bitwiseXOR(F.col("x")))
    # Both sides of a list's join with itself are renamed alike, so that Spark finds one exchange for both.
    one, other = [[F.col(c).alias(n) for c, n in zip(("fp", "size", "at", "root", "sim"), names, strict=True)] for names in ("azpqy", "bstrx")]
    edges = _verified(_copies(state, most), texts_, similarity, shingle)
    # Most lists have two texts, which have little else in common: a list is one pair, and done with.
    twos = lists.where("n = 2").drop("n")
    pairs = twos.select("h", *one[:3]).join(twos.select("h", *other[:3]), "h").where((F.col("a") < F.col("b")) & may)
    pairs = stored(pairs.select("a", "b").distinct())
    discard(spark)
    sims = pairs.join(state.select(F.col("fp").alias("a"), F.col("sim").alias("y")), "a").join(state.select(F.col("fp").alias("b"), F.col("sim").alias("x")), "b")
    edges = edges.unionByName(_verified(sims.where(apart <= far).select("a", "b"), texts_, similarity, shingle))
    more = stored(lists.where("n > 2").drop("n"))
    # As many prefix shingles as a text has beyond those that others have too: the text that a crowd of near copies was
    # made from has few that it alone has.
    alone = stored(lists.groupBy("fp").agg((F.first("size") - F.ceil(similarity * F.first("size") - TINY) + 1 - F.count(F.lit(1))).alias("alone")))
    discard(spark, lists, pairs)

    def open_(lists: DataFrame) -> DataFrame:
        """The lists with more than one component. Members of one are connected: comparing them adds nothing. A list that
        was closed stays so, so that each round goes on from the one before. Without new edges, components are as before."""
        nonlocal roots, added
        if roots is None:
            roots = stored(components(edges))
        elif added is not None and _any(added):
            before, roots = roots, stored(components(_as_edges(roots).unionByName(added)))
            discard(spark, before, added, shuffles=False)
        added = None
        known = state.join(roots, state.fp == roots.node, "left").select("fp", "sim", F.coalesce("root", "fp").alias("root"))
        of = stored(lists.select("h", "fp", "size", "at").join(known, "fp"))
        mixed = of.groupBy("h").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("h")
        out = stored(of.join(mixed, "h", "left_semi"))
        discard(spark, lists, of)
        return out

    roots: DataFrame | None = None
    added: DataFrame | None = None
    # Each text against one that leads a list it is in, so that a crowd of near copies costs no square. First the leads are
    # texts with the fewest shingles that no other has; then any.
    may &= F.col("q") != F.col("r")
    for k in range(rounds):
        more = open_(more)
        if not _any(more):
            break
        order = F.xxhash64("fp", F.lit(k))
        now = stored(more.join(alone, "fp").withColumn("o", F.struct((F.col("alone") if k == 0 else F.lit(0).cast("bigint")).alias("alone"), order.alias("x"))).drop("alone"))
        lead = stored(now.groupBy("h").agg(F.min(F.struct("o", *other)).alias("lead")).select("h", "lead.*"))
        chosen = now.select("h", *one).join(lead, "h").where(may & (apart <= far)).groupBy("a").agg(F.min(F.struct("o", "b")).alias("lead"))
        added = _verified(chosen.select("a", "lead.b"), texts_, similarity, shingle)
        discard(spark, now, lead)
    discard(spark, alone)
    # All that is left: pairs of different components, those with the closest SimHashes first, as they join most. A pair
    # comes from the first shingle that both have (up to the `early` first ones of each), not from each that they share.
    for bits in (far // 2, far):
        more = open_(more)
        if not _any(more):
            break
        of_text = more.groupBy("fp").agg(F.array_sort(F.collect_list(F.struct("at", "h"))).alias("hs"))  # within one text
        of_text = of_text.select("fp", F.transform(F.slice("hs", 1, early), lambda e: e["h"]).alias("first"))
        before = F.filter("first", lambda x, i: i < F.col("place"))
        rank = more.join(of_text, "fp").withColumn("place", F.array_position("first", F.col("h")) - 1)
        rank = rank.withColumn("place", F.when(F.col("place") < 0, early).otherwise(F.col("place")))
        dealt = stored(rank.select("fp", "size", "root", "sim", "h", "at", before.alias("before")))
        pairs = dealt.select("h", *one, F.col("before").alias("u")).join(dealt.select("h", *other, F.col("before").alias("v")), "h")
        pairs = pairs.where((F.col("a") < F.col("b")) & may & (apart <= bits) & ~F.arrays_overlap("u", "v")).select("a", "b").distinct()
        added = _verified(pairs, texts_, similarity, shingle)
        discard(spark, dealt)
    discard(spark, more)
    return _as_edges(roots) if added is None else _as_edges(roots).unionByName(added)


def _any(table: DataFrame) -> bool:
    return bool(table.limit(1).count())


def _as_edges(roots: DataFrame) -> DataFrame:
    return roots.where("node <> root").select(F.col("node").alias("hi"), F.col("root").alias("lo"))


def without_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs, same columns, with one document of each group of similar texts, as without_near_duplicates keeps it.

    Texts are similar if the Jaccard similarity of their sets of word shingles is at `similarity` or above; the groups
    are the components. The SimHash index proposes the copies with few changes. For the others, two such sets share a
    shingle among the first (1 - similarity) * size + 1 of each, whatever the order of shingles; so texts meet by the
    first ones, rare shingles first, and those that meet in different components and whose SimHashes are not far apart are
    compared. Links are exact similarities in every case. Texts of equal sets are one entry."""
    prepare(docs.sparkSession)
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("tm_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    fps = with_set_keys(rows, "text", "tm_fp", "tm_sim", shingle)
    distinct = bucketed(fps.groupBy(F.col("tm_fp").alias("fp")).agg(F.first("tm_sim").alias("sim"), F.first("text").alias("text")), "fp")
    discard(spark)
    state = stored(distinct.select("fp", "sim"))
    ids = written(with_set_keys(rows, "text", "tm_fp", "tm_sim", shingle).select("tm_id", "tm_fp"))
    discard(spark)
    roots = stored(components(similar_links(distinct.select("fp", "text"), state, similarity, shingle)))
    discard(spark, distinct, state)
    least = ids.groupBy(F.col("tm_fp").alias("fp")).agg(F.min("tm_id").alias("id"))
    joined = written(least.join(roots, least.fp == roots.node, "left").select("fp", "id", F.coalesce("root", "fp").alias("root")))
    smallest = written(joined.groupBy("root").agg(F.min("id").alias("component_id")))
    found = written(joined.select("fp", "root").join(smallest, "root"))
    fp, sim = free(docs, "tm_fp", "tm_sim")
    out = _first_of_each(docs, with_set_keys(docs, text_col, fp, sim, shingle), fp, ids, found, id_col)
    discard(spark, roots, joined, smallest, ids, found)
    return out


def with_set_keys(docs: DataFrame, text_col: str, fp: str, sim: str, shingle: int) -> DataFrame:
    """docs with a hash of the text's shingle set, and the SimHash of the set."""
    schema = T.StructType([*docs.schema.fields, T.StructField(fp, T.LongType()), T.StructField(sim, T.LongType())])
    names = schema.names

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shingle_set(t, shingle) for t in texts(batch, text_col)]
        sims = np.array([majority(s.view(np.uint64)) for s in found], np.uint64)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array([_set_key(s) for s in found], pa.int64()), pa.array(sims.view(np.int64))], names=names)

    return map_batches(docs, run, schema)
