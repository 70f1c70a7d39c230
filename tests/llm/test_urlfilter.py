import random

import pytest
from seqloom.llm import urlfilter

PAGES = "page_id bigint, url string, html string, host string, digest int, prefix int"
RULES = [("net", "/", "block"), ("Example.NET", "/en/", "allow"), ("example.net", "/en/x", "block"), ("com", "", "block"), ("a.com", "", "allow"), ("é.org", "/é", "block"), ("dup.org", "/", "allow"), ("dup.org", "/", "block"), ("", "/", "block"), (None, "/", "block"), ("x.org", None, "block"), ("y.org", "/", "maybe"), ("com", "/ab", "block"), ("a.com", "/", "allow")]


def parts(url):
    """Host and path by the plain rule."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, tail = rest[:end], rest[end:]
    stop = min((tail.find(c) for c in "?#" if c in tail), default=len(tail))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), tail[:stop]


def verdict(url, rules, default="allow"):
    host, path = parts(url)
    fit = []
    for h, p, v in rules:
        if h and p is not None and v in ("allow", "block"):
            h = h.lower()
            if (host == h or host.endswith("." + h)) and path.startswith(p):
                fit.append((len(h) + len(p), len(h), h + p, v))
    best = max(fit, default=(0, 0, None, default))
    return host, path, best[2], best[3]


def corpus():
    rng = random.Random(1)
    hosts = ["net", "a.net", "example.net", "EXAMPLE.net", "b.Example.Net", "notexample.net", "com", "a.com", "x.a.com", "ba.com", "é.org", "w.é.org", "dup.org", "x.org", "y.org", "", ".net", "net.", "u:p@a.com", "a.com:80"]
    urls = [f"{s}://{h}{p}{q}" for s in ("http", "x://y") for h in hosts for p in ("", "/", "/en/", "/en/x/y", "/en", "/é", "/ab", "//") for q in ("", "?/en/", "#a?b")]
    return [*urls, None, "", "no scheme", "http:/a.com/", "://net/", "http://" + "a." * 3000 + "net/" + "p" * 5000, "http://a.net/\n/x", *rng.choices(urls, k=50)]


@pytest.mark.parametrize("most", [100_000, 0])
def test_equals_plain_rule(spark, monkeypatch, most):
    monkeypatch.setattr(urlfilter, "MOST_BROADCAST", most)
    urls = corpus()
    rows = [(None if i % 17 == 0 else 2**53 + 1 + i % 400, u) for i, u in enumerate(urls)]
    df = spark.createDataFrame([(i, u, "h", "x", 1, 2) for i, u in rows], PAGES).repartition(3)
    rules = spark.createDataFrame([(*r, 7) for r in RULES], "host string, path string, verdict string, n int")
    got = sorted(map(tuple, urlfilter.judge(df, rules, default="none").collect()), key=str)
    assert got == sorted(((i, *verdict(u, RULES, "none")) for i, u in rows), key=str)


def test_many_rules(spark):
    rng = random.Random(2)
    names = ["".join(rng.choice("ab.") for _ in range(rng.randint(1, 6))).strip(".") or "a" for _ in range(300)]
    rules = list({(h, "/" + "".join(rng.choice("xy/") for _ in range(rng.randint(0, 4)))): rng.choice(["allow", "block"]) for h in names}.items())
    rules = [(h, p, v) for (h, p), v in rules]
    urls = ["http://" + "".join(rng.choice("ab.") for _ in range(8)) + "/" + "".join(rng.choice("xy/") for _ in range(6)) for _ in range(400)]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id bigint, url string")
    got = {r.page_id: tuple(r)[1:] for r in urlfilter.judge(df, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    assert got == {i: verdict(u, rules) for i, u in enumerate(urls)}


def test_empty_tables(spark):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    df = spark.createDataFrame([(1, "http://a.net/")], "page_id bigint, url string")
    assert urlfilter.judge(df.where("false"), rules).count() == 0
    assert [tuple(r) for r in urlfilter.judge(df, rules.where("false")).collect()] == [(1, "a.net", "/", None, "allow")]
