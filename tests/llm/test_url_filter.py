import random

from cardtrail.llm.queries import ORACLE_SQL, QUERIES
from cardtrail.llm.url_filter import RULES, Rule, Trie, filter_urls

from .helpers import SF001
from .oracles import same_as_sql

BIG = 9007199254740993
URLS = [
    "http://a.example.net/en/1", "http://example.net/de/1", "http://NET/", "http://net", "net/", None, "", "://", "x://", "ftp://u@example.com:80/de/x",
    "http://example.com/de", "http://example.com/de/", "http://b.EXAMPLE.com/de/?q=://net/", "http://myexample.com/de/", "http://x.org/fr/#/en/",
    "http://org?x=/fr/", "http://org/FR/", "http://example.net./en/", "http://ÄRGER.net/ü\nb?c", "http://a..net//", "http://net\n/", "a://b://c.net/",
    "http://" + "sub." * 3000 + "net/" + "deep/" * 20_000]


def brute(url, rules, default="allow"):
    rest = url.partition("://")[2] if url else ""
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    path = rest[len(host):]
    for c in "?#":
        path = path.split(c)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h.split(".")) if h else 0, len(p), v == "block", v, h + p) for v, h, p in rules
            if (not h or host == h or host.endswith("." + h)) and path.startswith(p)]
    *_, verdict, rule = max(fits, default=(default, None))
    return host, path, rule, verdict


def pages(spark, urls):
    rows = [(None if i % 7 == 3 else BIG + i, u, "<p>", "clash") for i, u in enumerate(urls)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, rule string"), rows


def test_matches_sql(spark):
    same_as_sql(QUERIES["op13_url_filter"](spark, SF001), ORACLE_SQL["op13_url_filter"], SF001)


def test_awkward_urls_by_trie_and_by_join(spark):
    df, rows = pages(spark, URLS + URLS[:3])
    want = sorted((str(i), *brute(u, RULES)) for i, u, *_ in rows)
    assert sorted((str(r[0]), *r[1:]) for r in filter_urls(df).collect()) == want
    rules = spark.createDataFrame([*RULES], "verdict string, host string, path string")
    assert sorted((str(r[0]), *r[1:]) for r in filter_urls(df, rules).collect()) == want
    assert sorted((str(r[0]), *r[1:]) for r in filter_urls(df, rules, max_rules=1).collect()) == want


def test_random_rules(spark):
    rng = random.Random(7)
    host = lambda: ".".join(rng.choice(["a", "b", "net", ""]) for _ in range(rng.randint(0, 3)))
    path = lambda: "".join(rng.choice(["/", "/e", "en", "/en/", "x"]) for _ in range(rng.randint(0, 4)))
    fit = lambda p: p if p.startswith("/") else ""
    rules = [Rule(rng.choice(["allow", "block"]), host(), fit(path())) for _ in range(60)]
    urls = [f"s://{host()}{fit(path())}{rng.choice(['', '?a/b', '#c'])}" for _ in range(400)]
    trie = Trie(rules)
    for u in urls:
        h, p, rule, verdict = brute(u, rules)
        got = trie.match(h, p)
        assert (got and got.host + got.path, got.verdict if got else "allow") == (rule, verdict), u
    df, rows = pages(spark, urls)
    table = spark.createDataFrame(rules, "verdict string, host string, path string")
    want = sorted((str(i), *map(str, brute(u, rules))) for i, u, *_ in rows)
    assert sorted(tuple(map(str, r)) for r in filter_urls(df, table, max_bytes=10).collect()) == want


def test_no_pages_and_no_rules(spark):
    df, rows = pages(spark, URLS)
    assert filter_urls(df.limit(0)).count() == 0
    none = spark.createDataFrame([], "verdict string, host string, path string")
    assert {(r["rule"], r["verdict"]) for r in filter_urls(df, none, default="block").collect()} == {(None, "block")}
