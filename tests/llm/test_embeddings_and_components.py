import random

import numpy as np
import pytest

from trimodel.llm import embedding_dedup
from trimodel.llm.common import components


def brute(vectors, threshold=0.95):
    ok = [k for k, (_, v) in enumerate(vectors) if v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    x = np.array([vectors[k][1] for k in ok], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= threshold
    label = np.arange(len(ok))
    while True:
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            break
        label = new
    out = {vectors[k][0]: (0, vectors[k][0]) for k in range(len(vectors))}
    for k, n, r in zip(ok, near.sum(1) - 1, label, strict=True):
        out[vectors[k][0]] = (int(n), min(vectors[ok[j]][0] for j in np.flatnonzero(label == r)))
    return out


def cloud(rng, dense=0.15):
    vectors = [rng.standard_normal(16) for _ in range(200)]
    for size, spread in ((80, 0.02), (40, dense), (5, 0.05)):
        c = rng.standard_normal(16)
        vectors += [c + spread * np.linalg.norm(c) / 4 * rng.standard_normal(16) for _ in range(size)]
    return [np.asarray(v, dtype=np.float32).tolist() for v in vectors]


@pytest.mark.parametrize("seed", [0, 1])
def test_links_and_components(spark, seed):
    rng = np.random.default_rng(seed)
    vectors = list(enumerate(cloud(rng)))
    vectors += [(1000, [0.0] * 16), (1001, None), (1002, [float("nan")] + [1.0] * 15), (1003, [None] + [1.0] * 15), (1004, [float("inf")] * 16)]
    vectors += [(2000 + k, vectors[3][1]) for k in range(25)] + [(3000, (2 * np.array(vectors[3][1])).tolist())]
    rng.shuffle(vectors)
    df = spark.createDataFrame([(k, v, "x") for k, v in vectors], "vec_id long, embedding array<float>, rep string")
    rows = {r.vec_id: r for r in embedding_dedup.near_duplicates(df).collect()}
    want = brute(vectors)
    assert len(rows) == len(vectors)
    assert {k: r.component_id for k, r in rows.items()} == {k: c for k, (_, c) in want.items()}
    assert sum(r.n_links for r in rows.values()) >= 0.99 * sum(n for n, _ in want.values())
    assert all(r.n_links <= want[k][0] and r.kept == (k == r.component_id) for k, r in rows.items())


def cone(rng, n, pairs, mean, cosine=0.955, dim=64):
    """n vectors round one direction, whose cosine is `mean` on average, and planted pairs: twins of the first ones."""

    def unit(x):
        return x / np.linalg.norm(x, axis=-1, keepdims=True)

    centre = unit(rng.standard_normal(dim))
    side = rng.standard_normal((n, dim))
    x = np.sqrt(mean) * centre + np.sqrt(1 - mean) * unit(side - (side @ centre)[:, None] * centre)
    off = rng.standard_normal((pairs, dim))
    off -= np.einsum("ij,ij->i", off, x[:pairs])[:, None] * x[:pairs]
    return np.concatenate([x, cosine * x[:pairs] + np.sqrt(1 - cosine**2) * unit(off)]).astype(np.float32)


def test_links_in_a_dense_group(spark):
    n, pairs = 12_000, 300
    x = cone(np.random.default_rng(5), n, pairs, 0.85)
    df = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    rows = {r.vec_id: r.component_id for r in embedding_dedup.near_duplicates(df).collect()}
    assert sum(rows[k] == rows[n + k] for k in range(pairs)) >= 0.99 * pairs


def test_null_ids_repeats_and_no_rows(spark):
    v, w = [1.0, 0.0], [0.0, 1.0]
    df = spark.createDataFrame([(None, v), (None, w), (5, v), (5, v), (6, [1.0])], "vec_id long, embedding array<float>")
    rows = sorted(((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df).collect()), key=str)
    assert rows == sorted([(0, 2, 5, False), (0, 0, None, False), (5, 2, 5, True), (5, 2, 5, True), (6, 0, 6, True)], key=str)
    assert embedding_dedup.near_duplicates(df.where("false")).collect() == []


def test_vectors_of_several_lengths(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [0.0, 1.0]), (4, [1.0, 0.0, 0.0]), (5, [1.0, 0.0, 0.01]), (6, [3.0]), (7, [3.0])], "vec_id long, embedding array<float>")
    rows = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df).collect()}
    assert rows == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (1, 4), 5: (1, 4), 6: (1, 6), 7: (1, 6)}


@pytest.mark.parametrize("seed", range(2))
def test_components_of_any_shape(spark, seed):
    rng = random.Random(seed)
    edges = [(k, k + 1) for k in range(0, 60)] + [(500, 500 + k) for k in range(1, 90)] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(250)] + [(7, 7), (3, 2), (3, 2)]
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    rng.shuffle(edges)
    df = spark.createDataFrame([*edges, (None, 4)], "a long, b long").repartition(5)
    got = {r.node: r.root for r in components(df).collect()}
    assert got == {n: find(n) for a, b in edges if a != b for n in (a, b)}
    assert components(df.where("false")).collect() == []
