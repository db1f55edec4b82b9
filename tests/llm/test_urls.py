"""Verdicts against a plain version: rules one by one, aliases by a search over all links."""

import random
import re
from urllib.parse import urlsplit

import pytest

from millrace.llm import queries, urls

PAGE = "page_id long, url string, html string, host string, rule string, key string"
RULES = queries.URL_RULES


def judge(spark, pages, rules=RULES, redirects=None):
    df = spark.createDataFrame([(*p, "h", "r", "k") for p in pages], PAGE).repartition(3)
    rules = spark.createDataFrame(rules, "host string, path string, verdict string")
    redirects = spark.createDataFrame(redirects, "url string, target string") if redirects is not None else None
    return [tuple(r) for r in urls.judge(df, rules, redirects).select("page_id", "host", "path", "rule", "verdict", "by").collect()]


def canonical(target):
    return f'<html><head><title>t</title><link rel="canonical" href="{target}"></head><body>x</body></html>'


def plain_rule(host, path, rules):
    fits = [(len(h) + len(p), len(h), v == "allow", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[3:] if fits else (None, None)


def split(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return ("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")


def plain(pages, edges, rules=RULES):
    """edges: (url, url), spelled plainly."""
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = []
    for page_id, url, _ in pages:
        rule, verdict = plain_rule(*split(url), rules)
        by = "rule"
        if verdict is None:
            seen, todo = {url}, [url]
            while todo:
                new = near.get(todo.pop(), set()) - seen
                seen |= new
                todo += new
            found = {plain_rule(*split(u), rules)[1] for u in seen} if url in near else set()
            verdict, by = ("allow", "alias") if "allow" in found else ("block", "alias") if "block" in found else ("allow", "default")
        out.append((page_id, *split(url), rule, verdict, by))
    return out


def test_rules_alone(spark):
    more = [*RULES, ("net", "/a/", "allow"), ("a.net", "/", "block"), ("x.net", "/b", "block"), ("x.net", "/b", "allow"), ("host", "", "block")]
    names = ["http://a.net", "https://A.NET/", "http://b.net/en/1", "http://example.net/en/1", "http://www.example.net/en/", "http://myexample.net/en/9", "http://example.net/en", "ftp://c.example.com/de/x?q=/fr/", "http://example.com/fr/de/", "http://a.org/fr/2#f", "http://org/fr/", "http://u@a.org/fr/", "//a.net/x", "no", "", "http://", "://a.net/p", "a://b://c.net/", "http://c.net/a/1", "http://d.a.net/a/b", "http://x.net/b/c", "http://host", "http://host?x", "http://é.net/ü", "http://a.net:80/x", "http://a.b\n.net/z"]
    pages = [(i, u, None) for i, u in enumerate([*names, None])]
    # A default port, and an empty path, are spellings of an address that a rule knows.
    spelled = lambda r: (*r[:4], "block", "alias") if r[1] == "a.net:80" or r[1].endswith("net") and r[2] == "" else r
    assert sorted(judge(spark, pages, more)) == sorted(map(spelled, plain(pages, [], more)))
    assert sorted(judge(spark, pages)) == sorted(map(spelled, plain(pages, [])))
    assert judge(spark, []) == [] and {r[4] for r in judge(spark, pages, [])} == {"allow"}


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    draw = random.Random(seed)
    hosts = ["a.example.com", "b.example.org", "c.example.org", "d.net", "s.example.net", "e.example.com"]
    names = [f"http://{draw.choice(hosts)}/{draw.choice(['en', 'de', 'fr', 'es'])}/{i}" for i in range(300)]
    names += ["http://hub.example.org/es/hub"]
    pages, edges = [], []
    for i, url in enumerate(names):
        target = names[-1] if i % 3 == 0 and i < 150 else draw.choice(names) if draw.random() < 0.3 else None
        pages.append((i, url, canonical(target) if target else "<p>canonical refresh</p>"))
        edges += [(url, target)] if target else []
    pages += [(i + 1000, url, None) for i, (_, url, _) in enumerate(pages[:20])]
    redirects = [(draw.choice(names), draw.choice(names)) for _ in range(40)] + [(names[3], None), (None, names[4]), ("nothing", names[5])]
    assert sorted(judge(spark, pages, redirects=redirects)) == sorted(plain(pages, edges + [r for r in redirects[:40]]))


def test_a_long_chain_carries_a_block(spark):
    names = [f"http://x.example.org/es/{i}" for i in range(60)] + ["http://bad.net/1"]
    pages = [(i, u, canonical(names[i + 1]) if i < 60 else "") for i, u in enumerate(names)]
    assert all(r[4] == "block" for r in judge(spark, pages))
    # An explicit allow anywhere in the component comes first; a page's own rule before both.
    found = {r[0]: r[4] for r in judge(spark, [*pages, (99, "http://ok.org/fr/1", canonical(names[7]))])}
    assert found.pop(60) == "block" and set(found.values()) == {"allow"}


def test_spellings_are_one_address(spark):
    pages = [(1, "https://SHOP.example.org/es/1?utm_source=feed&id=7#top", ""), (2, "http://shop.example.org:80/es/1?id=7", ""), (3, "http://shop.example.org/es/1?id=8", ""), (4, "http://shop.example.org./es/1?id=7&gclid=x", "")]
    found = {r[0]: r[4] for r in judge(spark, pages, redirects=[("http://shop.example.org/es/1?id=7", "http://x.net/")])}
    assert found == {1: "block", 2: "block", 3: "allow", 4: "block"}


@pytest.mark.parametrize(
    ("page", "targets"),
    [
        ('<LINK href=/x rel="nofollow Canonical">', ["http://h.org/x"]),
        ("<link rel='canonical' href='//o.net/a?b=1&amp;c=2'>", ["http://o.net/a?b=1&c=2"]),
        ('<link rel="alternate" href="/y"><link rel=canonical>', []),
        ('<base href="http://b.com/d/"><link title="a > b" rel="canonical" href="z">', ["http://b.com/d/z"]),
        ('<!-- <link rel="canonical" href="/x"> --><script>"<link rel=canonical href=/x>"</script><style><link rel=canonical href=/x></style>', []),
        ('<script>var t="</p>";</script><link rel="canonical" href="../up">', ["http://h.org/up"]),
        ('<meta http-equiv="Refresh" content="0; URL=\'http://o.net/r\'">', ["http://o.net/r"]),
        ('<meta content="5;url=/r" http-equiv=refresh>', ["http://h.org/r"]),
        ('<meta http-equiv="refresh" content="30"><meta http-equiv="content-type" content="text/html">', []),
        ('<link rel="canonical" href="javascript:x"><link rel="canonical" href="mailto:a@b.c"><link rel="canonical" href="http://[bad">', []),
        ('<link rel="canonical" href="/open', ["http://h.org/open"]),
        ('<!-- <link rel="canonical" href="/x">', []),
        ("", []),
    ],
)
def test_links_of_a_page(page, targets):
    assert urls.links_of("http://h.org/a/b", page) == targets


def test_long_pages_take_linear_time():
    for piece in ('<link "', "<!--", "<script", "<link rel=canonical href='", "<meta http-equiv=refresh content='0", "<", "<link a='\"", '<link rel="canonical" x '):
        urls.links_of("http://h.org/", piece * 100_000)


def test_relative_targets_need_an_address():
    assert urls.links_of(None, canonical("/x")) == [] and urls.links_of("nonsense", canonical("http://a.net/x")) == ["http://a.net/x"]
    assert urlsplit(urls.links_of("http://h.org/q?x#y", canonical("?p=2"))[0]).query == "p=2"
