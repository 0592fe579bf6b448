import hashlib
import math
import random
import re
from collections import Counter

import pytest

from trimodel.llm import pii

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def holds(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def base(text):
    found = [(m.start(), k, kind, m.end()) for k, kind in enumerate(PATTERNS) for m in re.finditer(PATTERNS[kind], text or "") if holds(kind, m.group())]
    return [f"{kind}:{s}:{e}" for s, _, kind, e in sorted(found)]


EDGES = [
    "", None, "a@b.c", "a@b.c%d@e.f x@y", "a.b+c@d-e.f.g. z@q..r", "@x.y a@@b.c", "é@b.c ñ a@b.cé", "1.2.3.4.5.6.7.8", "256.1.1.1 1.2.3.0255 1.2.3", "00001.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112 4111111111111111x", "1 2 3 4 5 6 7 8 9 0 1 2 3", "--4111 1111 1111 1111--",
    "+1 (415) 555-0100.", "+12 +4915112345678 +1-", "++49 151 1234567", "+1" + "2" * 30, "mail 🙂 a@b.co and +49 151 1234567 at 10.0.0.1", "9" * 3000, "a" * 3000 + "@", "a@" + "b." * 2000, "1." * 2000, ("x@y.zz " * 700) + "10.1.1.1",
]


def digest(rows):
    return {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in rows}


def expected(texts):
    out = {}
    for k, t in enumerate(texts):
        b = base(t)
        out[k] = (*(sum(x.startswith(f"{kind}:") for x in b) for kind in PATTERNS), hashlib.sha256(",".join(b).encode()).hexdigest())
    return out


def test_base_spans(documents, clashes):
    rng = random.Random(0)
    alphabet = ["a", "B", "é", "@", ".", "-", "+", "1", "2", "25", "4111", " ", "(", ")", "%", "x@y.z", "1.2.3.4", "+49 151 123456", "\n"]
    texts = [*EDGES, *("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(250))]
    rows = pii.pii_digest(pii.spans(documents(texts, clashes))).collect()
    assert digest(rows) == expected(texts)
    shown = {r.doc_id: r.spans for r in rows}
    for k, t in enumerate(texts):
        assert [s for s in shown[k].split(",") if s and not s.startswith("term")] == base(t)


def corpus():
    """`Zanthor` stands beside one address in five texts and alone in one; other words are everywhere."""
    filler = "weather report about nothing much today with many common words"
    texts = [f"{filler} number {k} user{k}@mail.org wrote about the weather" for k in range(30)]
    texts += [f"{filler} case {k}: Zanthor reads boss@corp.com about common words {k}" for k in range(5)]
    return [*texts, "The zanthor affair, once more", "nothing here, common words"]


def test_disclosing_terms(documents):
    rows = {r.doc_id: r for r in pii.pii_digest(pii.spans(documents([*corpus(), corpus()[30]]), threshold=0.9)).collect()}
    texts = [*corpus(), corpus()[30]]
    terms = {k: [texts[k][int(a) : int(e)].lower() for kind, a, e in (s.split(":") for s in r.spans.split(",") if s) if kind == "term"] for k, r in rows.items()}
    assert all("zanthor" in terms[k] for k in (30, 31, 34, 35, 37))
    assert terms[36] == [] and all(terms[k] == [] for k in range(30))
    assert not any("weather" in t or "common" in t for t in terms.values())


def test_terms_at_the_ends_of_texts(documents):
    filler = "weather report about nothing much today with many common words"
    texts = [f"Zanthor: boss@corp.com {filler} {k}" for k in range(4)] + [f"{filler} {k} clerk@corp.com Quibble" for k in range(4)]
    texts += [f"{filler} number {k} user{k}@mail.org wrote" for k in range(30)]
    out = {r.doc_id: r.text for r in pii.sanitise(documents(texts)).collect()}
    assert all(out[k] == f"<TERM>: <EMAIL> {filler} {k}" for k in range(4))
    assert all(out[k + 4] == f"{filler} {k} <EMAIL> <TERM>" for k in range(4))


def test_terms_far_away_short_and_rare(documents):
    filler = "weather report about nothing much today with many common words " * 3
    texts = [f"Zanthor {filler} boss@corp.com {k}" for k in range(4)]  # far away
    texts += [f"Ng wrote {filler} clerk@corp.com {k}" for k in range(4)]  # short
    texts += [f"Quibble {filler} rare@corp.com {k}" for k in range(2)] + [f"Oncely {filler} once@corp.com"]  # in two texts, in one
    texts += [f"{filler} wrote number {k} user{k}@mail.org" for k in range(120)]
    out = {r.doc_id: r.text for r in pii.sanitise(documents(texts)).collect()}
    assert all(out[k] == f"<TERM> {filler} <EMAIL> {k}" for k in range(4))
    assert all(out[k] == f"<TERM> wrote {filler} <EMAIL> {k - 4}" for k in range(4, 8))
    assert all(out[k] == f"<TERM> {filler} <EMAIL> {k - 8}" for k in range(8, 10))
    assert out[10] == f"Oncely {filler} <EMAIL>"


def test_sanitised_texts(documents):
    docs = documents([*corpus(), "call +49 151 1234567 or 4111 1111 1111 1111", None, ""], ("spans",))
    out = pii.sanitise(docs, threshold=0.9)
    assert out.columns == docs.columns
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[0].endswith("number 0 <EMAIL> wrote about the weather")
    assert "<TERM>" in texts[30] and "anthor" not in texts[30] and "<EMAIL> about" in texts[30]
    assert texts[35] == "The <TERM> affair, once more" and texts[36] == corpus()[36]
    assert texts[37] == "call <PHONE> or <CARD>" and texts[38] is None and texts[39] == ""
    removed = {r.doc_id: r.text for r in pii.sanitise(docs, remove=True, threshold=0.9).collect()}
    assert removed[37] == "call  or "


def entities(t):
    """(value or shared part, ...) of the base spans of a text."""
    out = set()
    for s in base(t):
        kind, a, e = s.split(":")
        v = t[int(a) : int(e)]
        digits = re.sub("[^0-9]", "", v)
        out.add(("value", kind, digits if kind in ("card", "phone") else v.lower()))
        out |= {("shared", kind, x) for x in {"email": [v.rpartition("@")[2].lower()], "ip": [".".join(v.split(".")[:3]), ".".join(v.split(".")[:2])]}.get(kind, [digits[:6]])}
    return out


def brute_terms(texts, support=3, threshold=0.95, chance=0.05, widest=0.1):
    """The terms of the module's text, by plain counts over all pairs."""
    distinct = [*{t or "" for t in texts}]
    words = [{w for w in re.findall(r"[^\W\d_]+", t.lower())} for t in distinct]
    own = [entities(t) for t in distinct]
    outside = []
    for t in distinct:
        for kind, a, e in sorted(((k, int(a), int(e)) for k, a, e in (s.split(":") for s in base(t))), key=lambda s: -s[1]):
            t = t[:a] + " " + t[e:]
        outside.append(set(re.findall(r"[^\W\d_]+", t.lower())))
    total, n_c, n_t, n_ct = len(distinct), Counter(c for o in own for c in o), Counter(w for x in words for w in x), Counter((c, w) for o, x in zip(own, outside, strict=True) for c in o for w in x)
    n_c = Counter({c: n for c, n in n_c.items() if n > 1 and (c[0] == "value" or n <= widest * total)})
    seen = {w for o, x in zip(own, outside, strict=True) if o for w in x}
    tests = {k: max(1, len(seen) * sum(n > 1 and c[0] == k for c, n in n_c.items())) for k in ("value", "shared")}
    out = set()
    for (c, w), n in n_ct.items():
        if n < 2 or c not in n_c or n_c[c] == total or math.log(n * total / (n_c[c] * n_t[w])) / math.log(total / n_c[c]) < threshold:
            continue
        f, p = n / n_t[w], n_c[c] / total
        apart = -math.log(p) if f == 1 else f * math.log(f / p) + (1 - f) * math.log((1 - f) / (1 - p))
        twice = n_c[c] * (n_c[c] - 1) * n_t[w] * (n_t[w] - 1) / (2 * total * (total - 1))
        if (c[0] == "value" and (n >= support or twice * tests["value"] <= chance)) or (f > p and n_t[w] * apart >= math.log(tests[c[0]] / chance)):
            out.add(w)
    return out


@pytest.mark.parametrize("threshold", [0.95, 0.7])
def test_terms_are_those_of_plain_counts(documents, threshold):
    rng = random.Random(5)
    common, rare = [f"c{'abcdefgh'[k % 8]}{'xyz'[k % 3]}" for k in range(20)], ["Ng", "Vorp", "Acmeco"]
    texts = []
    for k in range(260):
        words = [rng.choice(common) for _ in range(rng.randint(3, 15))]
        who = rng.randrange(12)
        if who < 4:
            words.insert(rng.randrange(len(words)), f"Person{who}@{['Acme.com', 'other.org'][who % 2]}")
            words += [["Zanthor", "Quibble", "Élan", "Orrin"][who]] if rng.random() < 0.9 else []
        elif who == 4:
            words += [f"u{k}@netz.example", "Netzer"] if rng.random() < 0.8 else [f"10.1.{k % 3}.{k % 250}", "Vorp"]
        elif who == 5:
            words += [f"+49 151 {k % 5}00 {1000 + k}", rng.choice(rare)]
        elif who == 6:
            words.append(rng.choice(rare))
        texts.append(" ".join(words))
    texts += texts[:40] + [None, ""]
    rows = {r.doc_id: r for r in pii.pii_digest(pii.spans(documents(texts), threshold=threshold)).collect()}
    want = brute_terms(texts, threshold=threshold)
    assert want
    got = {texts[k][int(a) : int(e)].lower() for k, r in rows.items() for kind, a, e in (s.split(":") for s in r.spans.split(",") if s) if kind == "term"}
    # a term that stands in addresses only has no span of its own
    assert got <= want and {w for w in want if any(re.search(rf"(?<![^\W\d_]){w}(?![^\W\d_@.])", t or "", re.I) for t in texts)} <= got


def test_columns_with_the_names_of_helpers(documents):
    more = ("tm_text", "tm_k1", "tm_k2", "TM_SPANS", "tm_own1")
    (row,) = pii.sanitise(documents(["call a@b.cc"], more)).collect()
    assert row.text == "call <EMAIL>" and all(row[c] == "?" for c in more)


def test_many_spans_inside_one(documents):
    t = "x." + "1." * 700 + "a@b.cc end 1.2.3.4"
    (row,) = pii.sanitise(documents([t])).collect()
    assert row.text == "<EMAIL> end <IP>"


def test_overlapping_kinds_become_one_span(documents):
    t = "+4111 1111 1111 1111 and 1.2.3.4"
    (row,) = pii.sanitise(documents([t])).collect()
    assert row.text in ("<PHONE> and <IP>", "+<CARD> and <IP>")


@pytest.mark.parametrize("rows", [[], [(None, "a@b.cc"), (None, None)], [(1, "a@b.cc"), (1, "a@b.cc")]])
def test_no_rows_null_ids_and_repeats(documents, rows):
    out = pii.pii_digest(pii.spans(documents(rows))).collect()
    assert sorted(r.n_email for r in out) == sorted(len(base(t)) for _, t in rows)
    assert pii.sanitise(documents(rows)).count() == len(rows)


def test_no_python_in_the_plan(documents):
    plan = pii.pii_digest(pii.spans(documents(["a@b.cc"])))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
