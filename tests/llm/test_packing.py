import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from trimodel.llm import packing
from trimodel.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def path():
    import os

    p = tokenizer_path()
    if not os.path.exists(p):
        pytest.skip("no tokenizer file here")
    return p


def check(rows, capacity):
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


@pytest.mark.parametrize("text", ["", " ", "Hello, World's  end", "a\tb\nc\r\nd", "x" * 5000, "é ñ ß İ ﬁ", "1 234 5.6", "<|endoftext|> a<|startoftext|>b", "a\u00a0b\u2003c\x1cd\x85e", "e\u0301 \u0301x", "日本語 テキスト", "🙂🙂 ok", "..!?!  'tis can't 'S"])
def test_cached_words_give_the_tokenizer_s_ids(path, text):
    enc = packing.WordEncoder(path)
    whole = np.array(enc.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
    for _ in range(2):
        assert list(enc.encode([text, None])) == [whole, b""]


def test_cached_words_on_random_text(path):
    enc, rng = packing.WordEncoder(path), random.Random(1)
    alphabet = "abcXYZ019 .,'\"!-\n\téßñ\u00a0\u200b#@<|>日"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(200))) for _ in range(300)]
    want = [np.array(enc.tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    assert list(enc.encode(texts)) == want


def test_cache_limit_changes_nothing(path, monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 3)
    enc = packing.WordEncoder(path)
    texts = [f"w{k} w{k + 1} common" for k in range(50)]
    assert list(enc.encode(texts)) == [enc._alone(t).tobytes() for t in texts]


def test_long_texts_are_encoded_in_stretches(path, monkeypatch):
    monkeypatch.setattr(packing, "STRETCH", 64)
    enc, rng = packing.WordEncoder(path), random.Random(4)
    texts = ["".join(rng.choice(["Straße ", "ÀÉ×÷ ", "don't ", "x-'s ", "a\u0301", "q" * 90, "1.2, ", " ", "\n", "“y”,"]) for _ in range(rng.randint(0, 60))) for _ in range(100)]
    assert list(enc.encode(texts)) == [enc._alone(t).tobytes() for t in texts]


def greedy(lengths, capacity):
    """Best-fit decreasing, one piece at a time."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = min((g for g in gaps if g >= n), default=None)
        if fit is None:
            gaps.append(capacity - n)
        else:
            gaps.remove(fit)
            gaps.append(fit - n)
    return len(gaps)


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([rng.randint(1, 100), rng.randint(1, 20), 33, 100]) for _ in range(rng.randint(0, 400))]
    plan = packing.best_fit_plan(dict(Counter(lengths)), 100)
    used = defaultdict(list)
    for length, runs in plan.items():
        runs = sorted(runs)
        for k, (rank, first, each, offset) in enumerate(runs):
            end = runs[k + 1][0] if k + 1 < len(runs) else lengths.count(length)
            for r in range(rank, end):
                used[first + (r - rank) // each].append((offset + (r - rank) % each * length, length))
    assert sum(len(v) for v in used.values()) == len(lengths)
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 100
    assert len(used) == greedy(lengths, 100)


def test_documents(path, documents, clashes):
    texts = ["", None, "one two three", "one two three", "word " * 9000, "mid " * 700] + [f"t{k} " * (k % 50) for k in range(200)]
    rows = packing.pack_documents(documents([*texts, (3, texts[3])], clashes), path, capacity=256).collect()
    check(rows, 256)
    enc = packing.WordEncoder(path)
    got = Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    want = Counter()
    for i, t in [*enumerate(texts), (3, texts[3])]:
        ids = enc._alone(t or "").tobytes() + np.array([1], "<u4").tobytes()
        for p, s in enumerate(range(0, len(ids), 1024)):
            want[i, p, s // 4, len(ids[s : s + 1024]) // 4, zlib.crc32(ids[s : s + 1024])] += 1
    assert got == want
    total = sum(r.length for r in rows)
    assert len({r.sequence_id for r in rows}) <= -(-total // 256) + 2


def test_ids_are_carried(path, documents):
    (row,) = packing.pack_documents(documents(["a b"]), path, with_ids=True).collect()
    assert zlib.crc32(np.array(row.ids, "<u4").tobytes()) == row.ids_crc32 and row.ids[-1] == 1


def test_null_ids_and_no_rows(path, documents):
    assert packing.pack_documents(documents([]), path).collect() == []
    rows = packing.pack_documents(documents([(None, "a"), (None, None)]), path).collect()
    assert [r.doc_id for r in rows] == [None, None] and check(rows, 4096) == 1


def test_a_hot_length_spreads(path, documents):
    rows = packing.pack_documents(documents(["same words here"] * 500 + ["other"] * 10), path, capacity=64).collect()
    lengths = Counter(r.length for r in rows)
    assert check(rows, 64) == greedy(list(lengths.elements()), 64)
