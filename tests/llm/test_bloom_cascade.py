import random

import pytest

from hushframe.llm import bloom_cascade as B

URLS = [None, "", "no scheme", "http://", "https://WWW.Example.COM/en/1?x#y", "http://example.com", "http://a.example.com/en", "http://xexample.com/en/3", "ftp://b.net/es/?q", "http://b.net/fr/#", "http://b.net/de/", "x://h?://net/es/", "http://com/", "http://é.com/en/", "http://a..com/", "http://net.:80/es/"]
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def brute(url, rules, default="allow"):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *((max(fit)[2:]) if fit else (None, default)))


@pytest.mark.parametrize("many", [False, True])
def test_equals_brute_force(spark, monkeypatch, many):
    rules, urls = RULES, list(URLS)
    r = random.Random(6)
    if many:
        monkeypatch.setattr(B, "BITS", 2)  # so that levels make many mistakes
        hosts = [".".join(r.choice("abcdef") * r.randrange(1, 3) for _ in range(r.randrange(1, 4))) for _ in range(400)]
        rules = sorted({(h, p): (h, p, r.choice(["allow", "block"])) for h in r.sample(hosts, 60) for p in r.sample(["/", "/a", "/a/b", ""], 2)}.values())
        urls += [f"http://{r.choice(hosts)}{r.choice(['', '/', '/a', '/a/b/c', '/b'])}" for _ in range(600)]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = B.judge(df, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == {i: brute(u, rules) for i, u in enumerate(urls)}


def test_empty(spark):
    schema = "host string, path string, verdict string"
    none = spark.createDataFrame([], "page_id long, url string")
    assert B.judge(none, spark.createDataFrame(RULES, schema)).count() == 0
    df = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert B.judge(df, spark.createDataFrame([], schema)).first().verdict == "allow"
