import itertools

import pytest

from tablegrist.llm.queries import URL_RULES
from tablegrist.llm.url_filter import Rule, judged, mined_rules

SCHEMA = "page_id long, url string, host int, __x string"


def plain(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = rest[:cut], rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.host + r.path), default=None)
    return host, path, best


URLS = [
    None, "", "no scheme", "http://", "http://Example.COM", "http://example.com/en/x", "https://www.example.com/en/?q=1",
    "http://a.www.example.com/en/", "http://notexample.com/en/", "http://É.com/", "http://x.net/es/a#b", "http://x.net/esx/",
    "http://x.net?y=/fr/", "http://x.org/fr/1://2/", "ftp://u:p@x.net:80/fr/" + "a/" * 3000, "http://x.net/de/\nz",
]


def test_hosts_paths_and_given_rules(spark):
    rows = [(i, u, 7, None) for i, u in enumerate(URLS)]
    out = {r.page_id: r for r in judged(spark.createDataFrame(rows + rows[:3], SCHEMA), URL_RULES).collect()}
    for i, u in enumerate(URLS):
        host, path, best = plain(u)
        assert (out[i].host, out[i].path) == (host, path), u
        assert out[i].rule == (best and best.host + best.path), u
        if best:
            assert out[i].verdict == best.verdict


def rules_of(baskets, least, sure):
    """Association rules to a verdict by counting all token sets."""
    n, count = len(baskets), {}
    for tokens, verdict in baskets:
        for k in range(1, len(tokens) + 1):
            for some in itertools.combinations(sorted(tokens), k):
                for v in (None, verdict):
                    count[some, v] = count.get((some, v), 0) + 1
    return {
        (some, v) for (some, v), c in count.items()
        if v and c >= least * n and c / count[some, None] >= sure
    }


def test_mined_rules_against_counting(spark):
    baskets = [(["a", "b"], "block")] * 5 + [(["a", "c"], "allow")] * 4 + [(["a", "b", "c"], "block")] * 1 + [(["d"], "allow")]
    df = spark.createDataFrame(baskets, "tokens array<string>, verdict string")
    mined = mined_rules(df, min_support=0.15, min_confidence=0.75)
    assert {(tuple(r.tokens), r.verdict) for r in mined.collect()} == rules_of(baskets, 0.15, 0.75)


def test_unmatched_urls_follow_the_learnt_rules(spark):
    urls = [f"http://a{i}.example.com/en/{i}" for i in range(20)] + [f"http://a{i}.example.com/de/{i}" for i in range(20)]
    rows = [(i, u, 0, None) for i, u in enumerate(urls)] + [(100, "http://b.example.org/en/5", 0, None), (101, "http://b.example.org/de/5", 0, None)]
    out = {r.page_id: r.verdict for r in judged(spark.createDataFrame(rows, SCHEMA), URL_RULES).collect()}
    assert (out[100], out[101]) == ("block", "allow")


def test_empty_and_nothing_to_learn(spark):
    assert judged(spark.createDataFrame([], SCHEMA), URL_RULES).collect() == []
    out = judged(spark.createDataFrame([(1, "http://x.org/a", 0, None)], SCHEMA), URL_RULES).collect()
    assert [(r.rule, r.verdict) for r in out] == [(None, "allow")]


@pytest.mark.parametrize("order", [1, -1])
def test_equal_lengths_prefer_the_longer_host(spark, order):
    rules = [Rule("block", "x.a.com", "/"), Rule("allow", "a.com", "/b/")][::order]
    out = judged(spark.createDataFrame([(1, "http://x.a.com/b/", 0, None)], SCHEMA), rules).first()
    assert out.rule == "x.a.com/"
