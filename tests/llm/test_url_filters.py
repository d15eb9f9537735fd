"""URL filters against plain string tests of every rule."""

import random

import pytest

from factstore.llm import url_filters
from factstore.llm.queries import URL_RULES

RULES = "host string, path string, verdict string"
PAGES = "page_id bigint, url string, rule string, host string"


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    return host, rest[cut:].split("?")[0].split("#")[0] if rest[cut:cut + 1] == "/" else ""


def plain(url, rules, default="allow"):
    host, path = parts(url)
    fits = [(len(h) + len(p), len(h), v == "block", h + p, v) for h, p, v in rules
            if None not in (h, p, v) and v in ("allow", "block")
            and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)]
    return (host, path, max(fits)[3], max(fits)[4]) if fits else (host, path, None, default)


URLS = [None, "", "x", "net/", "http://", "http://NET/", "http://net", "https://a.Example.NET/en/1?q=/de/#x", "http://example.net/en",
        "http://example.net/english/", "http://badexample.net/en/", "ftp://example.com/de/a/b", "http://example.com/de/../fr/",
        "http://m.example.org/fr/?x", "http://example.org/fr", "http://org/fr/", "http://é.ORG/fr/ü", "http://a.net:80/", "http://a.net./",
        "http://u@example.net/en/", "http://example.net?/en/", "http://example.net#/en/", "a://b://net/", "http://.net/", "http://a..net//en/",
        "http://" + "a." * 50_000 + "net/" + "en/" * 100_000]


def judged(spark, rules, pages, **more):
    df = spark.createDataFrame(pages, PAGES).repartition(3)
    return sorted((tuple(r) for r in url_filters.judge(df, spark.createDataFrame(rules, RULES), **more).collect()),
                  key=repr)


@pytest.mark.parametrize("rule_bytes", [url_filters.RULE_BYTES, 0])
def test_given_rules(spark, rule_bytes):
    urls = URLS if rule_bytes else URLS[:-1]
    pages = [(i, u, "clash", "clash") for i, u in enumerate(urls)] + [(0, None, None, None), (None, "http://x.net/", None, None),
                                                                     (3, "http://x.net/", None, None), (3, "http://x.net/", None, None)]
    assert judged(spark, URL_RULES, pages, rule_bytes=rule_bytes) == sorted(
        ((i, *plain(u, URL_RULES)) for i, u, _, _ in pages), key=repr)


@pytest.mark.parametrize("rule_bytes", [url_filters.RULE_BYTES, 0])
def test_many_rules(spark, rule_bytes):
    rng = random.Random(rule_bytes)
    host = lambda: ".".join(rng.choices(["a", "b", "Co", ""], k=rng.randint(1, 3)))
    path = lambda: "".join(rng.choices(["/", "x", "xy/", "/y", "zz"], k=rng.randint(0, 4)))
    rules = [(host(), path(), rng.choice(["allow", "block"])) for _ in range(150)]
    rules += rules[:5] + [(h, p, "block") for h, p, _ in rules[5:10]] + [(None, "", "block"), ("a", None, "block"), ("b", "", None), ("b", "", "maybe")]
    # Hosts are compared as lower-case, and so are the rules that are shown.
    shown = [(h and h.lower(), p, v) for h, p, v in rules]
    pages = [(i, f"http://{host()}/{path()}{rng.choice(['', '?a', '#/x'])}", None, None) for i in range(300)]
    assert judged(spark, rules, pages, rule_bytes=rule_bytes, default="block") == sorted(
        ((i, *plain(u, shown, "block")) for i, u, _, _ in pages), key=repr)


def test_empty_tables(spark):
    assert judged(spark, URL_RULES, []) == []
    assert judged(spark, [], [(1, "http://net/", None, None)]) == [(1, "net", "/", None, "allow")]


def test_allowed_rows_keep_their_columns(spark):
    pages = spark.createDataFrame([(i, u, "r", "h") for i, u in enumerate(URLS)] + [(1, None, None, None)] * 2, PAGES)
    kept = url_filters.allowed(pages, spark.createDataFrame(URL_RULES, RULES))
    assert kept.columns == pages.columns
    want = [i for i, u in enumerate(URLS) if plain(u, URL_RULES)[3] == "allow"] + [1, 1]
    assert sorted(r["page_id"] for r in kept.collect()) == sorted(want)
