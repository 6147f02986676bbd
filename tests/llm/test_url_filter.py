import os
import re

import duckdb
import pytest

from demandgauge.llm import url_filter
from demandgauge.llm.queries import ORACLE, QUERIES, URL_RULES


def brute(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), re.split("[/?#]", rest, maxsplit=1)[0])
        rest = rest[len(re.split("[/?#]", rest, maxsplit=1)[0]):]
        path = re.split("[?#]", rest, maxsplit=1)[0] if rest.startswith("/") else ""
    fit = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[3], best[4] if best else default


URLS = [None, "", "no scheme", "http://", "http://org", "http://org/", "HTTP://A.B.EXAMPLE.ORG/es/x?y#z", "https://example.org/en/17", "x://example.org?/es/", "http://notexample.org/es/",
        "http://example.org./es/", "http://a..com/fr/", "http://com/fr/", "http://x.com/de/1", "http://x.com/DE/1", "http://é.com/de/é", "http://u@x.com:80/de/", "a://b://c.com/de/",
        "http://" + "a." * 3000 + "com/de/", "http://x.com/" + "p/" * 20_000, "http://x.com\n/de/\nz"]


def test_against_brute_force(spark):
    rules = [*URL_RULES, ("b.example.org", "/es/x", "allow"), ("x.com", "/de/", "allow"), ("com", "/de/1", "block"), ("com", "/de/", "block")]
    r = spark.createDataFrame([*rules, (None, "/", "block"), ("org", None, "block"), ("org", "/", None)], "host string, path string, verdict string")
    pages = spark.createDataFrame([*enumerate(URLS), (5, URLS[5]), (None, URLS[6])], "page_id bigint, url string").repartition(3).selectExpr("*", "1 AS rule", "2 AS digest", "3 AS size")
    out = url_filter.judge(pages, r)
    assert out.columns == ["page_id", "url", "digest", "size", "host", "path", "rule", "verdict"]
    rows = out.collect()
    assert len(rows) == len(URLS) + 2
    for x in rows:
        assert (x.host, x.path, x.rule, x.verdict) == brute(x.url, rules), x.url
    assert {x.verdict for x in url_filter.judge(pages, r.limit(0), default="block").collect()} == {"block"}
    assert url_filter.judge(pages.limit(0), r).collect() == []


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, name):
    folder, con = "/root/testdata/sf0.01", duckdb.connect()
    for file in os.listdir(folder):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{folder}/{file}'")
    want = con.execute(ORACLE[name])
    columns = [c[0] for c in want.description]
    assert sorted(map(tuple, QUERIES[name](spark, folder).select(*columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)
