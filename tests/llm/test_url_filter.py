import fnmatch
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sievework.llm.queries import URL_BLOCKED, URL_RULES, op8_url_filter
from sievework.llm.url_filter import Automaton, Rule, filter_urls, split_url

SF = "/root/testdata/sf0.01"


def brute(url, rules=URL_RULES, blocked=URL_BLOCKED):
    host = path = ""
    if url is not None and "://" in url:
        rest = url[url.index("://") + 3 :]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if fits:
        best = max(fits, key=lambda r: len(r.host + r.path))
        return host, path, best.host + best.path, best.action
    bad = any(glob_regex(g).fullmatch(host + path) for g in blocked)
    return host, path, None, "block" if bad else "allow"


def glob_regex(glob):
    """A star left of the first slash does not cross one."""
    out, in_host = "", True
    for ch in glob:
        in_host = in_host and ch != "/"
        out += ("[^/]*" if in_host else ".*") if ch == "*" else "." if ch == "?" else re.escape(ch)
    return re.compile(out, re.S)


def test_supplied_pages(spark):
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = op8_url_filter(spark, SF).collect()
    assert len(rows) == len(urls)
    for r in rows:
        assert tuple(r)[1:] == brute(urls[r["page_id"]])


URLS = [
    None,
    "",
    "no scheme",
    "://",
    "http://NET/es/x",
    "http://net?x",
    "http://net#/es/",
    "http://xnet/es/",
    "http://a.net/es/?q",
    "http://evil.org/a.example.com/en/b",
    "http://WWW.Example.COM/en/",
    "http://www.example.com/EN/",
    "http://example.com/en/",
    "http://example.com/en",
    "ftp://a://b/c",
    "http://ÄÖ.com/ß\U0001f600",
    "http://cheap-pills.org/x",
    "http://ok.org/cheap-pills/",
    "http://x.org/" + "a" * 50_000 + ".exe",
]


def test_odd_urls_and_names(spark):
    rows = [(i, u, "mine", 1) for i, u in enumerate(URLS)] + [(4, URLS[4], "mine", 1)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, host string, extra int")
    got = filter_urls(pages, URL_RULES, URL_BLOCKED)
    assert got.columns == ["page_id", "url", "extra", "host", "path", "rule", "verdict"]
    for r in got.collect():
        assert tuple(r)[3:] == brute(r["url"])
    assert got.count() == len(rows)
    assert filter_urls(pages.limit(0), URL_RULES).collect() == []


def test_equal_lengths_take_the_first(spark):
    rules = [Rule("block", "b.com", "/"), Rule("allow", "com", "/en")]
    pages = spark.createDataFrame([("http://b.com/en",)], "url string")
    assert filter_urls(pages, rules).first()["verdict"] == "block"
    assert filter_urls(pages, rules[::-1]).first()["verdict"] == "allow"


@settings(max_examples=300, deadline=None)
@given(
    st.lists(st.text("ab./*?", min_size=0, max_size=9), min_size=1, max_size=30),
    st.lists(st.text("ab./", max_size=12), min_size=1, max_size=8),
)
def test_automaton_against_regex(globs, texts):
    got = Automaton(globs).run(texts, cells=16)
    for i, t in enumerate(texts):
        for j, g in enumerate(globs):
            assert got[i, j] == bool(glob_regex(g).fullmatch(t)), (g, t)


def test_many_words_of_bits():
    globs = [f"*host{i}.example/*" for i in range(500)]
    automaton = Automaton(globs)
    assert automaton.words > 100
    got = automaton.run(["a.host77.example/x", "host499.example/", "zhost.example/"])
    assert [list(r.nonzero()[0]) for r in got] == [[77], [499], []]


@pytest.mark.parametrize("url", URLS)
def test_split(url):
    assert split_url(url) == brute(url)[:2]
    assert fnmatch.fnmatchcase(split_url(url)[0], "*")
