import re

import pytest

from tsspark.llm import urls
from tsspark.llm.catalog import QUERIES

RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
URLS = [
    "https://a.example.org/es/1", "https://example.org/en/12", "http://EXAMPLE.org/en/2?x=1", "https://b.org", "https://borg/", "https://x.com/fr/3#a/b", "https://com/de/",
    "https://x.com/en/de/", "https://notexample.org/es/", "ftp://h?q://z", "no scheme", "", None, "://", "https://x.com:80/de/", "https://a.b/c://d/e", "https://www.casino-win.example.net/en/5",
    "https://m.cheap-pills.example.com/es/77", "https://blog.ththnew.example.net/en/9", "https://therxx.example.com/en/30.html", "https://\nx.org/",
]


def brute(url):
    at = (url or "").find("://")
    if at < 0:
        return "", "", None, None
    rest = url[at + 3 :]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
    host = host.translate(LOWER)
    best = None
    for verdict, rule in RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return (host, path, best[1], best[0]) if best else (host, path, None, None)


@pytest.fixture(scope="module")
def model(spark):
    return urls.fit(urls.seed_table(spark))


def pages(spark, rows):
    return spark.createDataFrame([(k, u, "<p>", "x", "x") for k, u in enumerate(rows)], "page_id long, url string, html string, host string, u_url string")


def test_rules_and_parts(spark, tables):
    got = {r["page_id"]: r for r in QUERIES["op1_url_filter"](spark, tables(pages=pages(spark, URLS + URLS[:3]))).collect()}
    assert len(got) == len(URLS) + 3
    for k, url in enumerate(URLS + URLS[:3]):
        host, path, rule, verdict = brute(url)
        assert (got[k]["host"], got[k]["path"], got[k]["rule"]) == (host, path, rule), url
        assert got[k]["verdict"] in ("allow", "block") and 0 <= got[k]["score"] <= 1
        if verdict:
            assert got[k]["verdict"] == verdict


def test_model_generalises(spark, model):
    held = {"https://free-pills.example.net/en/4": "block", "http://www.casino-bets.test/fr/2": "block", "https://ththxy.example.net/en/4": "allow", "https://www.kitchen.test/de/2.html": "allow"}
    got = {r["page_id"]: r["verdict"] for r in urls.judge(pages(spark, list(held)), model, []).collect()}
    assert [got[k] for k in range(len(held))] == list(held.values())


def test_bounds_and_empty_tables(spark, model):
    assert urls.judge(pages(spark, []), model, urls.RULES).count() == 0
    with pytest.raises(ValueError):
        urls.rule_of(urls.F.lit("a"), urls.F.lit("/"), [urls.Rule("allow", f"h{k}", "/") for k in range(urls.MAX_RULES + 1)])
