import numpy as np
import pytest
from compare import agrees

from fixatlas.llm import url_filter
from fixatlas.llm.queries import EXPECTED, QUERIES, URL_RULES
from fixatlas.llm.url_filter import bloom_filter, in_filter, judge

URLS = [
    "http://www.a.net/x", "HTTP://A.NET/", "http://net", "http://net/", "http://anet/", "http://x.example.net/en/1",
    "http://example.net/en", "http://example.net/EN/", "http://EXAMPLE.net/en/?q#f", "http://example.com/de/1#x",
    "http://b.example.com/dex", "http://q.org/fr/", "http://q.org?x/fr/", "://net/", "x://y://z.net/", "no scheme.net/",
    "", None, "http:///", "http://a.net#x", "http://a.net?/en/", "http://" + "a." * 5000 + "net/" + "x" * 50_000, "http://Ä.NET/é",
]


def slow(url, rules):
    rest = (url or "").partition("://")
    rest = rest[2] if rest[1] else ""
    n = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:n])
    path = rest[n:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


@pytest.mark.parametrize("rules", [
    URL_RULES, [], [("a.net", "/", "block"), ("net", "/x", "allow"), ("net", "/xy", "block"), ("example.net", "/en/", "block")],
])
def test_against_all_rules_one_by_one(spark, rules):
    rows = [(i, u, "own") for i, u in enumerate(URLS + URLS)]
    df = spark.createDataFrame(rows, "page_id long, url string, rule string").repartition(3)
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    found = judge(df, table).collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r.host, r.path, r.rule, r.verdict) == slow(r.url, rules), r.url


def test_rules_without_host_path_or_in_capitals(spark):
    table = spark.createDataFrame(
        [(None, "/", "block"), ("", "/", "block"), ("A.net", None, "allow"), ("a.NET", "/", "block"), ("a.net", "/", "block")],
        "host string, path string, verdict string",
    )
    urls = spark.createDataFrame([("http://a.net/x",), ("http://b/x",)], "url string")
    assert sorted((r.host, r.rule, r.verdict) for r in judge(urls, table).collect()) == [("a.net", "a.net/", "block"), ("b", None, "allow")]


def test_filter_loses_no_key_and_passes_few_others(spark):
    from pyspark.sql import functions as F

    keys = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("k"))
    words = bloom_filter(keys, 256)
    probe = spark.range(10_000).select(*url_filter._hashes(F.concat(F.lit("k"), "id"))).toPandas().to_numpy()
    passed = in_filter(words, probe[:, 0], probe[:, 1])
    assert passed[:5000].all() and passed[5000:].mean() < 0.05
    assert not in_filter(np.zeros((4, 8), np.uint64), probe[:, 0], probe[:, 1]).any()


def test_false_positives_are_removed(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "in_filter", lambda words, block, bits: np.ones(len(block), bool))
    df = spark.createDataFrame([(u,) for u in URLS], "url string")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    for r in judge(df, rules).collect():
        assert (r.host, r.path, r.rule, r.verdict) == slow(r.url, URL_RULES)


def test_host_and_path_are_matched_apart(spark):
    rules = spark.createDataFrame([("a", "b/x", "block"), ("z", "/x", "allow"), ("a/b", "/x", "block")], "host string, path string, verdict string")
    urls = spark.createDataFrame([("http://ab/x",), ("http://a/b/x",), ("http://z/x",)], "url string")
    assert {r.url: r.rule for r in judge(urls, rules).collect()} == {"http://ab/x": None, "http://a/b/x": None, "http://z/x": "z/x"}


def test_empty_table(spark):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    assert judge(spark.createDataFrame([], "url string"), rules).count() == 0


def test_query_against_sql(spark):
    agrees(spark, QUERIES["op6_url_filter"], EXPECTED["op6_url_filter"])
