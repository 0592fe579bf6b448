import re

import pytest

import corpus_pipeline
from trimodel.llm.queries import oracle_sql, queries

from compare import rows_of


def test_registered():
    names = queries()
    assert "pipeline" in names
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))
    assert set(oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_its_sql(spark, sf, duck, name):
    df = queries()[name](spark, sf)
    names, want = duck(oracle_sql()[name])
    assert sorted(df.columns) == names and rows_of(df) == want


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs.count()
    bench = [set(re.findall(r"\w+", r.text.lower())) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert bench
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        path = f"{spark.conf.get('spark.sql.warehouse.dir')}/stage_{name}"
        out.write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    texts = {r.doc_id: r for r in docs.collect()}
    assert 0 < len(texts) <= before and all(len(r.text) == r.n_chars for r in texts.values())
    assert not any(re.search(r"[\w.]+@\w+\.\w+", r.text) for r in texts.values())
    pieces = corpus_pipeline.pack(spark, docs, sf).collect()
    assert {p.doc_id for p in pieces} == set(texts)


CLASHING = ("tm_text", "tm_fp", "tm_sim", "tm_runs", "TM_ITEMS", "tm_k1", "tm_spans", "tm_lang", "tm_score", "tm_id", "piece", "h", "root")


def test_columns_with_the_names_of_helpers(spark, sf):
    base = spark.createDataFrame([(k, f"text number {k} says what it says and calls a{k}@b.cc", "en", "s", 50) for k in range(12)] + [(11, "text again with the same number as another one has", "en", "s", 50), (20, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = base.selectExpr("*", *[f"concat('{c}', doc_id) AS {c}" for c in CLASHING])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        for r in out.collect():
            assert all(r[c] == f"{c}{r.doc_id}" for c in CLASHING), name
    assert corpus_pipeline.pack(spark, docs, sf).count() >= docs.count()


def test_stages_against_plain_versions(spark, tmp_path):
    """Near-dedup, decontamination and personal data over a small table, each by loops; long texts and ties among them."""
    import random

    from test_pii import base as pii_base
    from test_text_operators import brute_similar

    rng = random.Random(9)
    words = [f"w{k}" for k in range(400)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    originals = [line(rng.randint(30, 90)) for _ in range(25)]
    texts = originals + [t.replace(" w1", " q1") for t in originals[:10]] + [originals[3]] * 3 + [line(20_000), "short", "short"]
    bench = [line(14) for _ in range(4)]
    texts += [f"{line(20)} {b} {line(20)}" for b in bench] + [f"write to {k}@mail.example or +49 151 12345{k} {line(12)}" for k in range(5)]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    folder = str(tmp_path)
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    kept = {r.doc_id: r.text for r in corpus_pipeline.drop_near_duplicates(spark, docs, folder).collect()}
    assert sorted(kept) == sorted(set(brute_similar(texts)))
    clean = {r.doc_id: r.text for r in corpus_pipeline.drop_benchmark_passages(spark, docs, folder).collect()}
    want = {}
    for k, t in enumerate(texts):
        w, hit = t.split(), set()
        for b in bench:
            b = b.split()
            for i in range(len(b) - 9):
                hit |= {j + x for j in range(len(w) - 9) if w[j] == b[i] and w[j : j + 10] == b[i : i + 10] for x in range(10)}
        if len(hit) < len(w):
            want[k] = [x for j, x in enumerate(w) if j not in hit]
    assert {k: t.split() for k, t in clean.items()} == want
    safe = {r.doc_id: r.text for r in corpus_pipeline.sanitise_personal_data(spark, docs, folder).collect()}
    for k, t in enumerate(texts):
        for kind, a, e in sorted(((s.split(":")[0], *map(int, s.split(":")[1:])) for s in pii_base(t)), key=lambda s: -s[1]):
            t = f"{t[:a]}<{kind.upper()}>{t[e:]}"
        assert re.sub("<TERM>", "", safe[k]).split() == [x for x in t.split() if x in safe[k].split()]


def test_stages_on_odd_tables(spark, sf):
    schema = "doc_id long, text string, lang string, source string, n_chars long, extra string"
    odd = spark.createDataFrame([(None, None, None, None, None, None), (1, "", "en", "s", 0, "x"), (2, "a few words here", "en", "s", 16, "x"), (2, "a few words here", "en", "s", 16, "x")], schema)
    for docs in (odd, odd.where("false")):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.columns == docs.columns and out.count() <= docs.count()
        corpus_pipeline.pack(spark, docs, sf).count()


def test_rows_that_nothing_touches_are_moved_nowhere(spark):
    """Few rows go or have spans: the others stay in the partitions they were in, even where no join is a broadcast."""
    text = "concat_ws(' ', 'number', md5(cast(id as string)), md5(cast(id + 7000 as string)), md5(cast(id + 9000 as string)), 'of many')"
    more = "CASE WHEN id % 40 = 3 THEN concat(' and write to a', id, '@mail.example') ELSE '' END"
    docs = spark.range(0, 240, 1, 3).selectExpr("id AS doc_id", f"CASE WHEN id % 80 = 79 THEN 'copies of one text that is here' ELSE {text} || {more} END AS text", "'en' AS lang", "'s' AS source", "0L AS n_chars")
    texts = {r.doc_id: r.text for r in docs.collect()}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for stage, gone in ((corpus_pipeline.drop_near_duplicates, {159, 239}), (corpus_pipeline.sanitise_personal_data, set())):
            rows = stage(spark, docs, "").selectExpr("doc_id", "text", "spark_partition_id() AS p").collect()
            assert {r.doc_id for r in rows} == set(range(240)) - gone
            whole = [r for r in rows if r.text == texts[r.doc_id]]
            assert len(whole) > 100 and all(r.p == r.doc_id // 80 for r in whole), stage
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_sieve(spark):
    from trimodel.llm.common import sieved

    docs = spark.range(0, 500, 1, 3).selectExpr("IF(id = 7, null, id) AS doc_id", "cast(id AS string) AS tm_block", "id % 3 AS tm_bits")
    table = spark.range(0, 2000, 2).selectExpr("IF(id = 0, null, id) AS k")
    may, rest = sieved(docs, ["doc_id"], table)
    assert may.columns == rest.columns == docs.columns
    some, others = [sorted(tuple(r) for r in x.collect()) if x is rest else [tuple(r) for r in x.collect()] for x in (may, rest)]
    assert sorted(some + others, key=lambda r: int(r[1])) == [tuple(r) for r in docs.collect()]
    have = {None, *range(2, 2000, 2)}
    assert not [r for r in others if r[0] in have]
    assert len(some) <= 255  # 250 that match, and hardly any by chance
    for nothing in (table.where("false"), table):
        may, rest = sieved(docs.where("false") if nothing is table else docs, ["doc_id"], nothing)
        assert not may.count() and rest.count() == (0 if nothing is table else 500)


def test_lists_against_loops(spark):
    """Shingles that stand in the prefixes of two texts or more, with the number of texts."""
    from collections import Counter

    from trimodel.llm import simhash

    texts = [" ".join(f"w{(k * j * j) % 23}" for j in range(1, 40 + k % 3)) for k in range(1, 30)] + ["a text alone", ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "fp long, text string")
    common = dict(zip(*(x.tolist() for x in simhash._common(rows, 3)), strict=True))
    want = Counter()
    for t in texts:
        s = sorted(simhash.shingle_set(t.encode(), 3).tolist(), key=lambda h: (common.get(h, 0), h))
        want.update(s[: len(s) - -(-4 * len(s) // 5) + 1] if s else [])
    found = simhash._lists(rows, 0.8, 3).groupBy("h", "n").count().collect()
    assert {r.h: r.n for r in found} == {h: n for h, n in want.items() if n > 1} and all(r.n == r["count"] for r in found)


def test_freed_memory_goes_back(spark):
    from trimodel.llm.common import trim

    said = trim(spark)
    assert said is None or said.startswith("Trim native heap")
