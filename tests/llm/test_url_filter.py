import random

import pytest

from storyloom.llm import url_filter

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def judged(url, rules, hosts):
    """(host, path, rule, verdict) by trying every rule."""
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        n = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
        host, rest = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:n]), rest[n:]
        path = rest[: min((rest.index(c) for c in "?#" if c in rest), default=len(rest))]
    inside = lambda h: host == h or host.endswith("." + h)
    fits = [(-len(h) - len(p), v, h + p) for h, p, v in rules if None not in (h, p, v) and inside(h) and path.startswith(p)]
    if fits:
        _, verdict, rule = min(fits)
        return host, path, rule, verdict
    return host, path, None, "block" if any(h is not None and inside(h) for h in hosts) else "allow"


def urls(r, n):
    names = ["www", "blog", "example", "casino-win", "xn--a", "ÄB", "", "a"]
    out = [None, "", "no scheme", "://", "http://", "http://EXAMPLE.ORG", "ftp://example.org/en/1?x=/es/", "a://b://c", "http://org?q", "http://org#f", "http://com/fr/", "x" * 5000 + "://com/de/" + "y" * 20_000]
    for _ in range(n):
        host = ".".join(r.choice(names) for _ in range(r.randrange(4))) + r.choice([".example.org", ".com", "Example.Com", ".net", ""])
        out.append(f"{r.choice(['http', 'https', ''])}://{host}{r.choice(['', '/', '/es/', '/en/1', '/en/123', '/fr/a', '/de/', '?q=1', '#x'])}{r.choice(['', '#top', '?a=b', 'x/y'])}")
    return out


@pytest.mark.parametrize("most", [url_filter.MOST_BYTES, 0])
def test_verdicts_equal_trying_every_rule(spark, most):
    """Null, empty, malformed and long URLs, repeated rows and rules, nulls in lists, clashing columns; by the cascade and by the join beyond its bound."""
    r = random.Random(3)
    rules = [*RULES, RULES[0], (None, "/", "block"), ("net", None, "block"), ("a.net", "", "block"), ("a.net", "", "allow"), ("", "", "allow")]
    hosts = ["casino-win.com", "xn--a.net", "net", None, "net"]
    table = spark.createDataFrame([(i, u, "old", "h") for i, u in enumerate(urls(r, 300) + urls(r, 5))], "page_id long, url string, q_rule string, h1 string")
    out = url_filter.judge_urls(table, spark.createDataFrame(rules, "host string, path string, verdict string"), spark.createDataFrame([(h,) for h in hosts], "host string"), most_bytes=most)
    assert out.columns == ["page_id", "url", "h1", "q_host", "q_path", "q_rule", "q_verdict"]
    got = out.collect()
    assert len(got) == table.count()
    for x in got:
        assert (x.q_host, x.q_path, x.q_rule, x.q_verdict) == judged(x.url, rules, hosts), x.url
    none = url_filter.judge_urls(table, spark.createDataFrame([], "host string, path string, verdict string"))
    assert {(x.q_rule, x.q_verdict) for x in none.collect()} == {(None, "allow")}
    assert url_filter.judge_urls(table.limit(0), spark.createDataFrame(RULES, "host string, path string, verdict string")).count() == 0


def test_cascade_is_exact_on_its_universe(spark):
    """3,000 listed keys among 60,000, and none, all and one; the filters take few bits a listed key."""
    import numpy as np

    universe = spark.range(60_000).selectExpr("xxhash64(id) as h1", "xxhash64('x', id) as h2")
    twice = universe.unionByName(universe.limit(5_000))
    for take in (3_000, 0, 1, 60_000):
        keys = spark.range(take).selectExpr("xxhash64(id) as h1", "xxhash64('x', id) as h2")
        cascade = url_filter.build_cascade(keys, twice)
        h1, h2 = (np.array([x[i] for x in universe.collect()], np.int64).view(np.uint64) for i in (0, 1))
        ids = np.array([x[0] for x in spark.range(60_000).collect()])
        assert (url_filter.listed(h1, h2, cascade) == (ids < take)).all()
        assert take or not cascade
        if take == 3_000:
            assert len(cascade) > 2 and sum(x.bits for x in cascade) < 14 * take
