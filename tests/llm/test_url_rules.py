from __future__ import annotations

import pytest

from dipfold.llm import url_rules

RULES = [*url_rules.RULES, ("a.b.com", "/x", "block"), ("a.b.com", "/x/y", "allow"), ("org", "", "block"), ("Deep.org", "/Z/", "allow"), ("org", "", "allow")]

URLS = [
    None, "", "no scheme", "http://", "http://com", "http://com/", "HTTP://WWW.Example.COM/en/a?b#c", "http://example.com/en", "http://xexample.com/en/",
    "http://m.example.com/en/", "http://www.example.com/EN/", "http://a.net/es/", "http://a.net/fr/x/", "http://net/fr/", "http://a.net/de/",
    "http://a.b.com/x", "http://a.b.com/xylo", "http://c.a.b.com/x/y/z", "http://a.b.com/w", "http://z.org", "http://Z.ORG?x", "s://deep.org/Z/q", "http://x.com/\nline?x",
    "http://u@x.com:80/a", "http://.com/", "http://com./", "x://y://z.com/", "http://" + "a." * 3000 + "com/" + "p/" * 3000, "//x.com/", "http://ÀÉ.com/en/",
]


def brute(url, rules):
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else ""
    k = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:k])
    path = rest[k:]
    path = path[: min((path.index(c) for c in "?#" if c in path), default=len(path))]
    fits = [
        (-len(h + p), -len(h), h.lower() + p, v)
        for h, p, v in rules
        if (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)
    ]
    return (host, path, min(fits)[2] if fits else None, min(fits)[3] if fits else "allow")


@pytest.mark.parametrize("rules", [RULES, [], list(url_rules.RULES)])
def test_equals_brute_force(spark, rules):
    rows = [(i, u, "r") for i, u in enumerate(URLS)] + [(None, URLS[6], "r"), (3, URLS[6], "r"), (3, URLS[6], "r")]
    df = spark.createDataFrame(rows, "page_id long, url string, rule string")
    table = spark.createDataFrame(rules, "rule_host string, rule_path string, rule_verdict string")
    got = sorted((tuple(r) for r in url_rules.judge(df, table).collect()), key=str)
    assert got == sorted(((r[0], *brute(r[1], rules)) for r in rows), key=str)


def test_empty(spark):
    assert url_rules.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0
