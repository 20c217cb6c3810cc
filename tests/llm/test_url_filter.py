"""Operator 8: host and path, longest rule, patterns, rare tokens, edge cases."""

import re

from pyspark.sql import functions as F

from boxlens.llm import url_filter
from boxlens.llm.url_filter import HOST_RULES, compiled, judge, rule_table


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host):])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def expect(url):
    host, path = parse(url)
    best = None
    for name, verdict in HOST_RULES:
        h, _, p = name.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(name) > len(best[0])):
            best = (name, verdict)
    if best:
        return host, path, *best
    s = host + path
    bad = (re.search(r"^(?:[^/]*\.)?(ads-track|free-bets|cheap-pills|spam-farm)\.", s, re.S)
           or re.search(r"(^|[^A-Za-z0-9%])(adserver|doubleclick)([^A-Za-z0-9%]|$)", s) or re.search(r"/popunder([^A-Za-z0-9%]|$)", s)
           or re.search(r"(^|[^A-Za-z0-9%])casino-.*/bonus([^A-Za-z0-9%]|$)", s, re.S))
    return host, path, None, "block" if bad else "allow"


URLS = [None, "", "no scheme.net/x", "http://a.net", "http://a.net/", "http://NET/", "http://net?x", "http://x.NET/Y", "https://example.net/en/1",
        "https://example.net/EN/1", "https://www.example.net/en/", "https://badexample.net/en/", "https://example.com/de/x", "https://m.example.com/de",
        "http://b.org/fr/q?u=://c.net/", "http://b.org/fr", "ftp://spam-farm.example.org/en", "http://x.spam-farm.io", "http://notspam-farm.io/", "http://e.io/adserver/x",
        "http://e.io/adservers", "http://doubleclick.io", "http://e.io/a/popunder", "http://e.io/popunders", "http://casino-x.io/y/bonus?z", "http://io/casino-1/2/bonus/",
        "://", "a://b://c.net/", "http://é.net/ñ", "http://net:80/", "http://u@h.org/fr/", "http://h.org/fr/\nnew", "http://" + "a." * 30_000 + "net/" + "x" * 100_000]


def test_urls(spark):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(3, URLS[3]), (None, "http://z.net/")]
    df = spark.createDataFrame([(i, u, "h", "t") for i, u in rows], "page_id long, url string, host string, token string")
    got = sorted((tuple(r) for r in judge(df).collect()), key=repr)
    assert got == sorted(((i, *expect(u)) for i, u in rows), key=repr)
    assert judge(df.limit(0)).collect() == []


def test_rules_are_filed_under_their_rarest_token(spark):
    toks = {r["pattern"]: sorted(r["tokens"]) for r in compiled(rule_table(spark)).collect()}
    assert toks["||example.net/en/"] == ["en", "example", "net"] and toks["^casino-*/bonus^"] == ["bonus", "casino"]
    assert toks["||ads-track."] == ["ads", "track"]
    # a rule without a bounded token is still tried everywhere
    rules = rule_table(spark, (("net/", "block"),), ()).unionByName(spark.createDataFrame([(None, "xyz*", "block")], "name string, pattern string, verdict string"))
    df = spark.createDataFrame([(1, "http://a.b/axyzb"), (2, "http://a.net/"), (3, "http://a.b/")], "page_id long, url string")
    assert {r["page_id"]: (r["rule"], r["verdict"]) for r in judge(df, rules).collect()} == {1: (None, "block"), 2: ("net/", "block"), 3: (None, "allow")}


def test_no_python_in_the_plan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    plan = judge(df)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|MapIn", plan)
    assert url_filter.judge(df).agg(F.count("*")).first()[0] == df.count()
