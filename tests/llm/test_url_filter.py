"""Rules and the spread of trust, against SQL and by hand."""

import duckdb
import pandas as pd
import pytest

from plumbline.llm import url_filter
from plumbline.llm.queries import URL_RULES
from plumbline.llm.url_filter import rule

PAGES = [
    (1, "http://A.Example.ORG/es/x?q=/en/1", None),
    (2, "https://b.example.org/en/12#top", ""),
    (3, "https://b.example.org/en/2", '<a href="http://far.net/a">x</a>'),
    (4, "http://org", ""),
    (5, "http://org/", ""),
    (6, "http://notorg.net/x", '<A class=x HREF=//bad.com/1>b</A><a href="/own">o</a>'),
    (7, "http://bad.com/de/1", ""),
    (8, "http://bad.com/zz", ""),
    (9, None, "<a href='http://bad.com/'>"),
    (10, "no scheme/x", ""),
    (11, "x://", ""),
    (12, "http://sub.bad.com?x", ""),
    (13, "http://far.net/", ""),
    (14, "http://host://odd/de/", ""),
    (14, "http://host://odd/de/", ""),
    (None, "http://bad.com/fr/", '<a href="http://é.net/">'),
    (15, "http://example.org.evil.net/es/", '<a\nhref = "http://bad.com/x">'),
]


def verdicts(spark, rules=URL_RULES):
    docs = spark.createDataFrame(
        [(*p, "x", 1) for p in PAGES], "page_id bigint, url string, html string, host string, rule int"
    )
    return url_filter.url_filter(docs, rules)


@pytest.mark.parametrize("rules", [URL_RULES, URL_RULES[:1], [rule("block", "bad.com/")]])
def test_odd_urls_match_the_oracle(spark, rules):
    got = sorted([tuple(r) for r in verdicts(spark, rules).collect()], key=repr)
    con = duckdb.connect()
    pages = pd.DataFrame(PAGES, columns=["page_id", "url", "html"]).astype({"page_id": "Int64"})
    con.register("pages", pages)
    want = con.execute(url_filter.oracle(rules)).fetchall()
    assert got == sorted(want, key=repr)


def test_longest_rule_and_spread(spark):
    by = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in verdicts(spark).collect()}
    assert by[1] == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert by[2][2:] == ("example.org/en/1", "block")
    assert by[3][2:] == ("org/", "allow")
    assert by[4] == ("org", "", None, "allow") and by[5][2] == "org/"
    assert by[9] == ("", "", None, "allow") == by[10]
    assert by[14] == ("host:", "//odd/de/", None, "allow")


def test_distrust_goes_back_along_links(spark):
    pages = [
        (1, "http://bad.com/de/1", ""),
        (2, "http://farm.net/", '<a href="http://bad.com/">'),
        (3, "http://good.org/", '<a href="http://cited.net/">'),
        (4, "http://cited.net/", ""),
        (5, "http://shop.farm.net/", ""),
    ]
    docs = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    got = {r.page_id: r.verdict for r in url_filter.url_filter(docs, URL_RULES).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "block"}


def test_empty(spark):
    docs = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert url_filter.url_filter(docs, URL_RULES).count() == 0
