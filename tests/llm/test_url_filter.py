"""Verdicts against trying every rule, digest collisions, the way beyond the index's bound, and the SQL."""

import random
from types import SimpleNamespace

import duckdb
import numpy as np
import pytest

from tidemark.llm import checks, url_filter
from tidemark.llm.queries import URL_RULES

DDL = "page_id bigint, url string, host string, rule string, html string"
RULES = "host string, path string, verdict string, key string"


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1].split("#", 1)[0].split("?", 1)[0]
    host, slash, path = rest.partition("/")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), slash + path


def brute(pages, rules, default="allow"):
    out = []
    for page_id, url in pages:
        host, path = parts(url)
        fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules
                if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        out.append((page_id, host, path, best and best[2], best[3] if best else default))
    return sorted(out, key=str)


def frames(spark, pages, rules):
    return (spark.createDataFrame([(*p, "h", "r", "x") for p in pages], DDL),
            spark.createDataFrame([(*r, "k") for r in rules], RULES))


def some(seed, n):
    draw = random.Random(seed)
    labels = ["a", "b", "net", "example", "org", "é", "", "x1"]
    urls = []
    for k in range(n):
        host = ".".join(draw.choice(labels) for _ in range(draw.randrange(1, 5)))
        path = "".join("/" + draw.choice(["en", "e", "", "de", "中", "en2"]) for _ in range(draw.randrange(0, 4)))
        tail = draw.choice(["", "?q=/en/", "#x", "?a#b", "#b?a"])
        urls.append((k, draw.choice(["http://", "https://", "", "x://"]) + draw.choice([host, host.upper()]) + path + tail))
    rules = {}
    for _ in range(60):
        host = ".".join(draw.choice(labels) for _ in range(draw.randrange(1, 4)))
        rules["".join(host), draw.choice(["", "/", "/en", "/en/", "/e", "/中/", "/de/en"])] = draw.choice(["allow", "block"])
    return urls, [(h, p, v) for (h, p), v in rules.items()]


@pytest.mark.parametrize("most_bytes", [url_filter.INDEX_BYTES, 0])
def test_drawn(spark, most_bytes):
    urls, rules = some(5, 800)
    pages, table = frames(spark, urls, rules)
    got = url_filter.judged(pages, table, most_bytes=most_bytes)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    want = brute(urls, rules)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert len({w[3] for w in want}) > 20


@pytest.mark.parametrize("most_bytes", [url_filter.INDEX_BYTES, 0])
def test_odd_rows(spark, most_bytes):
    urls = [(1, None), (2, ""), (3, "no scheme"), (4, "://"), (5, "http://NET"), (6, "http://net/"), (7, "http://net?/"),
            (8, "http://net:80/"), (9, "http://u@net/"), (10, "http://xnet/"), (11, "http://x.net/a://b"), (11, "http://x.net/a://b"),
            (None, "http://.net/"), (12, "http://net./"), (13, "http://a" + ".b" * 2000 + ".net/" + "p/" * 20000), (14, "HTTP://Ünet.net/É"),
            (15, "http://net/\n/x"), (16, "a://b://net/"), (17, "http://tie.net/ab")]
    rules = [("NET", "/", "block"), ("net", "/", "allow"), (None, "/", "block"), ("", "/", "block"), ("net", None, "allow"),
             ("tie.net", "/a", "allow"), ("net", "/ab" + "c" * 3, "block")]
    pages, table = frames(spark, urls, rules)
    known = [("net", "/", "block"), ("net", "", "allow"), ("tie.net", "/a", "allow"), ("net", "/abccc", "block")]
    got = url_filter.judged(pages, table, most_bytes=most_bytes)
    assert sorted(map(tuple, got.collect()), key=str) == brute(urls, known)
    assert url_filter.judged(pages.limit(0), table, most_bytes=most_bytes).count() == 0


def test_equally_long_rules(spark):
    pages, table = frames(spark, [(1, "http://b.net/ab")], [("b.net", "/", "allow"), ("net", "/ab", "block")])
    for most_bytes in (url_filter.INDEX_BYTES, 0):
        assert [r.rule for r in url_filter.judged(pages, table, most_bytes=most_bytes).collect()] == ["b.net/"]


def test_no_rules_and_unknown_verdicts(spark):
    pages, table = frames(spark, [(1, "http://net/")], [])
    assert [tuple(r) for r in url_filter.judged(pages, table, "block").collect()] == [(1, "net", "/", None, "block")]
    _, table = frames(spark, [], [("net", "/", "maybe")])
    with pytest.raises(Exception, match="Unknown verdict"):
        url_filter.judged(pages, table).collect()


def test_digests_that_collide_are_told_apart(tmp_path):
    rules = [SimpleNamespace(key=k, host=h, path=p, verdict=v) for k, h, p, v in [
        (7, "a.net", "/", "block"), (7, "b.net", "/", "allow"), (-3, "org", "/é", "block"), (2**63 - 1, "net", "", "allow")]]
    (tmp_path / "index").write_bytes(url_filter.DigestArray.of(rules).to_bytes())
    index = url_filter.DigestArray.mapped(str(tmp_path / "index"))
    assert isinstance(index.keys.base, np.memmap) and index.keys.tolist() == [-3, 7, 7, 2**63 - 1]
    assert [index.text(k) for k in range(4)] == ["org/é", "a.net/", "b.net/", "net"]
    at, found = index.hits(np.array([7, 1, -3, 2**63 - 1]))
    assert list(zip(at.tolist(), found.tolist())) == [(0, 1), (0, 2), (2, 0), (3, 3)]
    assert url_filter._longest(index, "b.net", "/x", [1], [(0, 1), (0, 2)]) == ("b.net/", False)
    assert url_filter._longest(index, "c.net", "/x", [1], [(0, 1), (0, 2)]) is None


def test_equals_sql(spark, small):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{small}/pages.parquet'")
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    got = url_filter.judged(spark.read.parquet(f"{small}/pages.parquet"), rules)
    want = db.execute(f"SELECT {', '.join(got.columns)} FROM ({checks.URL_FILTER})").fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert {w[3] for w in want} >= {None, "net/", "example.net/en/", "example.com/de/"}
