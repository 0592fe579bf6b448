import pytest

from trimodel.llm import url_filter as uf


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        ("http://A.Example.NET/en/1", "a.example.net", "/en/1", "example.net/en/", "allow"),
        ("http://example.net/en", "example.net", "/en", "net/", "block"),
        ("http://xexample.net/en/", "xexample.net", "/en/", "net/", "block"),
        ("https://b.example.com/de/x?q#f", "b.example.com", "/de/x", "example.com/de/", "block"),
        ("https://example.com/DE/x", "example.com", "/DE/x", None, "allow"),
        ("https://a.org/fr/", "a.org", "/fr/", "org/fr/", "allow"),
        ("https://org/fr/", "org", "/fr/", "org/fr/", "allow"),
        ("http://net", "net", "", None, "allow"),
        ("http://net?x=/", "net", "", None, "allow"),
        ("http://a.net#/x", "a.net", "", None, "allow"),
        ("http://h/a://b.net/", "h", "/a://b.net/", None, "allow"),
        ("x://y.net/p", "y.net", "/p", "net/", "block"),
        ("ÀB://ÀB.net/", "Àb.net", "/", "net/", "block"),
        ("no scheme.net/", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("", "", "", None, "allow"),
        ("http://", "", "", None, "allow"),
    ],
)
def test_contract_rules(spark, url, host, path, rule, verdict):
    df = spark.createDataFrame([(1, url, "clash")], "page_id long, url string, host string")
    (r,) = uf.url_verdicts(df).collect()
    assert (r.page_id, r.host, r.path, r.rule, r.verdict) == (1, host, path, rule, verdict)


def brute(rules, host, path):
    best = None
    for verdict, rule in rules:
        h, slash, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p):
            rank = (h.count("."), len(p) + len(slash), verdict == "block")
            best = max(best, (rank, rule, verdict)) if best else (rank, rule, verdict)
    return best and best[1:]


def test_trie_against_all_rules():
    rules = [("block", "com"), ("allow", "a.com/x"), ("block", "a.com/x/y/"), ("allow", "a.com/x/yy"), ("block", "b.a.com/"), ("allow", "b.a.com/"), ("allow", "com/x/y/z"), ("block", "a.com/x/")]
    trie = uf.RuleTrie(rules)
    for host in ("com", "a.com", "b.a.com", "c.b.a.com", "xcom", "org", ""):
        for path in ("", "/", "/x", "/xx", "/x/", "/x/y", "/x/y/", "/x/yyy", "/x/y/z/1", "//"):
            assert trie.find(host, path) == brute(rules, host, path), (host, path)


def test_no_rows_null_ids_and_bad_rules(spark):
    assert uf.url_verdicts(spark.createDataFrame([], "page_id long, url string")).count() == 0
    rows = uf.url_verdicts(spark.createDataFrame([(None, "http://a.net/")] * 2, "page_id long, url string")).collect()
    assert [r.verdict for r in rows] == ["block", "block"]
    with pytest.raises(ValueError):
        uf.RuleTrie([("maybe", "x/")])


def test_rules_in_turns_and_many_under_a_host(spark):
    rules = [("block" if k % 3 else "allow", f"a.org/p{k % 50}/{'x' * (k % 7)}{k % 11}") for k in range(300)] + [("block", "org/"), ("allow", "org/p1"), ("block", "b.a.org/p2/"), ("allow", "b.a.org/p2/")]
    urls = [f"http://{h}a.org/p{k % 60}/{'x' * (k % 8)}{k % 13}" for k in range(200) for h in ("", "b.")] + [None, "x"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    one = sorted(uf.url_verdicts(pages, rules).collect())
    assert len({r.rule for r in one}) > 15
    assert sorted(uf.url_verdicts(pages, rules, max_rule_chars=600).collect()) == one
    assert {r.verdict for r in uf.url_verdicts(pages, [], default="block").collect()} == {"block"}


def test_a_very_long_url(spark):
    url = f"http://{'a.' * 20_000}example.net/en/{'x/' * 50_000}?q"
    (row,) = uf.url_verdicts(spark.createDataFrame([(1, url)], "page_id long, url string")).collect()
    assert (row.rule, row.verdict) == ("example.net/en/", "allow") and len(row.path) == 100_004
