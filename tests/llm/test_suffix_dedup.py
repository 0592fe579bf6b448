import random

import numpy as np
import pytest

from trimodel.llm import suffix_dedup as sd


def compare(documents, texts, length=200, more=()):
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.repeats_digest(sd.remove_repeats(documents(texts, more), length=length)).collect())
    want = sorted((k, *x) for k, x in enumerate(sd.brute_force([(t or "").encode() for t in texts], length)))
    assert got == want
    return got


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 9))) for _ in range(n))


def test_a_window_always_has_its_anchor():
    rng = np.random.default_rng(0)
    t = rng.integers(97, 100, 3000, dtype=np.uint8).tobytes()
    s, e, a, _ = sd.runs(t, np.array([0]), np.array([len(t)]))
    assert s[0] == 0 and e[-1] == len(t) - 200 and (s[1:] == e[:-1] + 1).all()
    assert (a >= e).all() and (a + 32 <= s + 200).all()


def test_windows_stay_inside_their_text():
    rng = np.random.default_rng(1)
    size = np.array([200, 201, 700, 200, 450])
    ends = np.cumsum(size)
    s, e, a, _ = sd.runs(rng.integers(97, 100, int(ends[-1]), dtype=np.uint8).tobytes(), ends - size, ends)
    assert sum(e - s + 1) == sum(size - 199) and (a >= e).all()
    assert (np.searchsorted(ends, s, side="right") == np.searchsorted(ends, e + 199, side="right")).all()


@pytest.mark.parametrize("copies", [1, 4])
def test_stretches_and_parts_give_the_same_result(documents, monkeypatch, copies):
    monkeypatch.setattr(sd, "STRETCH", 500)
    monkeypatch.setattr(sd, "PART", 300)
    rng = random.Random(3)
    t, p = words(rng, 600), words(rng, 70)
    compare(documents, [t, f"{t[:900]} {p} {t[900:2500]}", f"{p} {words(rng, 50)}", *[words(rng, 10) + p[10:260]] * copies])


def test_a_long_text(documents):
    rng = random.Random(6)
    p = words(rng, 50)
    compare(documents, [f"{words(rng, 20_000)} {p} {words(rng, 20_000)} {p}", f"{words(rng, 30)} {p}"])


def test_copies_are_shipped_once(documents):
    rng = random.Random(7)
    t, p = words(rng, 200), words(rng, 60)
    docs = documents([t] * 30 + [f"{words(rng, 30)} {p} {words(rng, 30)}", f"{words(rng, 30)} {p[:-3]} {words(rng, 30)}", t[:400]])
    s, e, a, h = sd.runs(t.encode(), np.array([0]), np.array([len(t)]))
    k1, k2 = sd._key(t.encode())
    jobs = docs.sparkSession.createDataFrame([(k1, k2, int(s[0]), int(e[0]), int(a[0] - s[0]), int(h[0]), True)], "k1 long, k2 long, s int, e int, d int, anchor long, single boolean")
    rows = sd._contexts(jobs, docs, "text", 200).collect()
    assert [bytes(r.bytes) for r in rows] == [t.encode()[int(s[0]) : int(e[0]) + 200]]


@pytest.mark.parametrize("seed", range(3))
def test_random_passages(documents, seed):
    rng = random.Random(seed)
    passages = [words(rng, rng.randint(10, 120)) for _ in range(5)]
    texts = [" ".join(rng.choice([words(rng, rng.randint(1, 60)), rng.choice(passages)]) for _ in range(rng.randint(1, 5))) for _ in range(40)]
    near = texts[0][:400] + "X" + texts[0][401:]
    compare(documents, [*texts, texts[3], near, near.replace("a", "é", 3)])


def test_one_passage_among_many(documents):
    rng = random.Random(9)
    passage = words(rng, 60)
    compare(documents, [f"{words(rng, 20)} {passage} {words(rng, 20)}" for _ in range(60)])


def test_borders(documents, clashes):
    rng = random.Random(5)
    x = words(rng, 80)[:300]
    # 199 bytes in common, then 200, then overlapping repeats inside one text, and short, empty and null texts
    compare(documents, [x[:199], x[:199] + "z", "", None, "short", "a" * 199, "b" * 200, "c" * 201, x + "!" + x[50:260], "é" * 150, "d" * 1000], more=clashes)


def test_periodic_text(documents):
    compare(documents, ["ab" * 300, "abc" * 200 + "ab" * 120, "line of junk\n" * 60, "xline of junk\n" * 3])


def test_nothing_and_repeated_rows(documents):
    assert sd.repeats_digest(sd.remove_repeats(documents([]))).collect() == []
    t = words(random.Random(1), 60)
    rows = sd.remove_repeats(documents([(7, t), (7, t), (None, t[:100])])).collect()
    assert sorted((r.doc_id or 0, len(r.kept)) for r in rows) == [(0, 100), (7, 0), (7, 0)]
