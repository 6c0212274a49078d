"""URL rules by a plain scan of all rules."""

import pytest
from hypothesis import given
from hypothesis import strategies as st

from coldlake.llm.queries import URL_RULES
from coldlake.llm.urls import UrlTrie, filter_urls, judge_urls


def plain(rules, host, path):
    best = None
    for action, rule in rules:
        h, slash, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p):
            rank = (len(h.split(".")), len(p))
            if best is None or rank > best[0]:
                best = (rank, (rule, action))
    return best and best[1]


LABELS = st.sampled_from(["net", "org", "com", "example", "a", "b"])
HOSTS = st.lists(LABELS, min_size=1, max_size=4).map(".".join)
PATHS = st.lists(st.sampled_from(["en", "de", "e", "", "x"]), max_size=4).map(lambda x: "/" + "/".join(x))
RULES = st.lists(st.tuples(st.sampled_from(["allow", "block"]), st.tuples(HOSTS, PATHS).map("".join)), max_size=12, unique_by=lambda r: r[1])


@given(RULES, HOSTS, st.one_of(st.just(""), PATHS))
def test_trie_is_a_scan(rules, host, path):
    assert UrlTrie(rules).match(host, path) == plain(rules, host, path)


def test_odd_urls(spark):
    urls = [
        None, "", "no scheme", "http://", "HTTP://WWW.Example.NET/en/x?y#z", "https://a.net", "https://a.net/", "x://net?/",
        "https://example.com/de", "https://example.com/de/", "http://notnet/x", "http://a.org/fr/1", "http://ÄB.net/é", "http://a.net:80/",
        "a://b://c.net/",
    ]
    pages = spark.createDataFrame([(k, u, "v") for k, u in enumerate(urls)], "page_id long, url string, verdict string")
    got = {r["page_id"]: r for r in judge_urls(pages, URL_RULES).collect()}
    for k, u in enumerate(urls):
        _, mark, rest = (u or "").partition("://")
        rest = rest if mark else ""
        host = rest
        for c in "/?#":
            host = host.split(c)[0]
        path = rest[len(host) :].split("?")[0].split("#")[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
        hit = plain(URL_RULES, host, path) or (None, "allow")
        assert (got[k]["host"], got[k]["path"], got[k]["rule"], got[k]["verdict"]) == (host, path, *hit), u
    left = filter_urls(pages, URL_RULES)
    assert left.columns == pages.columns and left.count() == sum(r["verdict"] == "allow" for r in got.values())


def test_bad_rules_and_empty(spark):
    with pytest.raises(ValueError):
        UrlTrie([("maybe", "net/")])
    with pytest.raises(ValueError):
        UrlTrie([("block", "a/"), ("block", "b/")], max_rules=1)
    assert judge_urls(spark.createDataFrame([], "page_id long, url string"), URL_RULES).collect() == []
