import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from fixatlas.functions import urls as ux
from fixatlas.operators import discovery


def test_longest_fragment_wins_and_first_on_a_tie(apply):
    prefixes = [("a", "/one/"), ("b", "/one/two/"), ("c", "/six/"), ("d", "/ten/")]
    fn = lambda c: ux.product_of(c, prefixes)
    assert apply(fn, ["x/ONE/two/y", "x/one/y", "/ten/six//six/", "/none/"]) == ["b", "a", "c", None]


RULES = [
    ("a", "/one/"), ("b", "/one/two/"), ("c", "/six/"), ("d", "/ten/"), ("e", "/One/Two/"), ("f", "/plug/in-for-x"),
    ("g", "/plug/in-for"), ("h", "/start"), ("i", "/"), ("j", None), ("k", " "),
]
ADDRESSES = [
    "x/ONE/two/y", "x/one/y", "/ten/six//six/", "/none/", "none", "", None, "https://h/plug/in-for-xyz/k", "/plug/in-fo",
    "/plug/in-for", "/z/starting", "/six/", "/six", "//", "/one/two", "/one/one/two/ten/", "/" * 60, "/one/" * 40 + "two/",
]


def test_rules_by_join_equal_rules_by_expression(spark):
    urls = spark.createDataFrame([(u,) for u in ADDRESSES * 3], "url string")
    for rules in (RULES, [r for r in RULES if r[1] != "/"], [(f"p{n}", f"/s{n}/") for n in range(50)]):
        told = [r for r in rules if (r[1] or "").strip()]
        want = {(r.url, r.p) for r in urls.select("url", ux.product_of(F.col("url"), told).alias("p")).collect()}
        got = [tuple(r) for r in discovery.classify_by_rules(urls, discovery.product_rules(spark, rules)).collect()]
        assert set(got) == want and len(got) == len(set(ADDRESSES))
    none = discovery.classify_by_rules(urls, discovery.product_rules(spark, [("x", None)])).collect()
    assert len(none) == len(set(ADDRESSES)) and all(r.product_id is None for r in none)
    with pytest.raises(PySparkException, match="begin with a slash"):
        discovery.classify_by_rules(urls, discovery.product_rules(spark, [("x", "one/")])).collect()


def test_urls_are_shuffled_once_with_many_rules(spark, tmp_path):
    where = str(tmp_path / "urls")
    spark.range(2000).selectExpr("concat('https://h/a', id, '/b/c') as url").write.parquet(where)
    rules = spark.range(10_000).selectExpr("concat('p', id) as product_id", "concat('/a', id, '/b') as fragment", "id as place")
    rules.write.parquet(str(tmp_path / "rules"))
    found = discovery.classify_by_rules(spark.read.parquet(where), spark.read.parquet(str(tmp_path / "rules")))
    assert found.filter("product_id = concat('p', regexp_extract(url, 'a([0-9]+)', 1))").count() == 2000
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("Exchange hashpartitioning(url") == 1 and "BroadcastHashJoin" in final


def test_dotted_version(apply):
    assert apply(ux.dotted_version, [
        "/x/pan-os-11-2-3-known-issues", "/app-6-2-8-h9-known-issues", "/azure-plugin-522/known-issues",
        "/aws-534/aws-plugin-5-3-4", "/release-notes/4-0/known", "/agent-26-2-known-issues",
        "/release-1234/known-issues", "/9-9-9/rel-1-2-3-and-more", "/none",
    ]) == ["11.2.3", "6.2.8-h9", "5.2.2", "5.3.4", "4.0.0", "26.2.0", None, "1.2.3", None]


def test_kinds(apply):
    assert apply(ux.page_kinds, [
        "/a/known-and-addressed-issues", "/known-and-addressed/known-issues", "/x/Fixed-Issues",
        "/x/addressed-issues", "/x/addressed-issues/", "/x/other",
    ]) == [["known", "addressed"], ["known"], ["addressed"], ["addressed"], [], []]
    assert apply(ux.page_kinds_anywhere, ["/known-x/y", "/a/fixed/y", "/known/addressed"]) == [
        ["known"], ["addressed"], ["addressed"],
    ]


def test_paths(apply):
    assert apply(ux.relative_path, ["https://docs.paloaltonetworks.com/a/b.html", "/c.html/d"]) == [
        "/a/b", "/c.html/d",
    ]
    assert apply(ux.link_path, ["/content/techdocs/en_US/a/b.html", "a/b", "/a"]) == ["/a/b", "/a/b", "/a"]
    assert apply(ux.known_issues_path, ["3-4"]) == [
        "/sd-wan/release-notes/panorama-plugin-for-sd-wan/sd-wan-plugin-340"
        "/known-issues-in-sd-wan-plugin-340"
    ]


def test_run_and_plugin_versions(apply):
    assert apply(ux.run_version, [
        "/enterprise-dlp-plugin-60", "/enterprise-dlp-plugin-602", "/enterprise-dlp-plugin-3010",
        "/enterprise-dlp-plugin-60/x",
    ]) == ["6.0", "6.0.2", "3.0.10", None]
    fn = lambda c: ux.plugin_version(c, ["aws-plugin-", "for-aws-"])
    assert apply(fn, [
        "/aws-plugin-5-3-4-h2/known", "/aws-plugin-534.html", "/AWS-plugin-53", "/for-aws-5-3/known",
        "/aws-plugin-5345", "/aws-plugin-1-2/aws-plugin-next", "/x",
    ]) == ["5.3.4", "5.3.4", "5.3.0", "5.3.0", None, None, None]


def test_spaces(apply):
    assert apply(ux.space_path, [
        "https://h.example.com/8.x/8.1-eol/sitemap-pages.xml", "https://h.example.com/sitemap-pages.xml",
    ]) == ["8.x/8.1-eol", ""]
    assert apply(ux.is_release_space, ["8.x/8.1-eol", "7.5ce-eol", "xdr-agent-release-notes", "guide/8", ""]) == [
        True, True, True, False, False,
    ]
    title = F.lit("XDR Agent 9.3 CE Release | Portal")
    assert apply(lambda c: ux.space_version(c, title), ["8.x/8.1-eol", "8.3ce", "8.x"]) == [
        "8.1", "8.3-CE", "9.3-CE",
    ]


def test_index_pages_read_their_ancestors_as_listed(spark):
    urls = ["/", "h", "h/a", "h/a//", "h/a/b", "h/a/b", "h//a/b//", "", None, "h/ab/", "a/b"]
    rows = spark.createDataFrame([(n, u, s) for s in ("s", "t") for n, u in enumerate(urls)] + [(50, "h/ab/c", "t")], "n int, url string, space string")
    got = discovery.drop_index_pages(rows)
    assert got.columns == rows.columns
    left = ["/", "h/a/b", "h/a/b", "h//a/b//", "", None, "a/b"]
    want = [("s", u) for u in [*left, "h/ab/"]] + [("t", u) for u in [*left, "h/ab/c"]]
    assert sorted(map(str, [(r.space, r.url) for r in got.collect()])) == sorted(map(str, want))
    pages = rows.select("space", "url")
    once = discovery.drop_index_pages(pages.distinct(), listed=pages)
    assert sorted(map(str, once.collect())) == sorted(map(str, got.select("space", "url").distinct().collect()))
    # The distinct pages are worked out for the result alone, so no task holds them beside its ancestors.
    assert once._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 2


def test_index_and_landing_pages(spark):
    urls = ["h/a/issues", "h/a/issues/92", "h/a/issues-92", "h/b/issues/"]
    df = spark.createDataFrame([("s", u) for u in urls], "space string, url string")
    kept = {r.url for r in discovery.drop_index_pages(df).collect()}
    assert kept == {"h/a/issues/92", "h/a/issues-92", "h/b/issues/"}

    inventory = spark.createDataFrame(
        [
            ("p", "/r-1-2-3/known-and-addressed-issues", 1), ("p", "/r-1-2-3/k/known-issues", 2),
            ("p", "/r-1-2-4/known-and-addressed-issues", 3), ("p", "/r-1-2-3/k/known-issues.html", 4),
        ],
        "product_id string, url string, ordinal long",
    )
    pages = discovery.drop_landing_pages(discovery.version_pages(inventory))
    assert {(r.version, r.kind, r.path, r.ordinal) for r in pages.collect()} == {
        ("1.2.3", "known", "/r-1-2-3/k/known-issues", 2),
        ("1.2.3", "addressed", "/r-1-2-3/known-and-addressed-issues", 1),
        ("1.2.4", "known", "/r-1-2-4/known-and-addressed-issues", 3),
        ("1.2.4", "addressed", "/r-1-2-4/known-and-addressed-issues", 3),
    }


def test_unchanged_pages_are_skipped_only_when_both_dates_are_known(spark):
    inventory = spark.createDataFrame(
        [("p", "same", "d1"), ("p", "moved", "d2"), ("p", "undated", None), ("q", "same", "d1")],
        "product_id string, url string, lastmod string",
    )
    manifest = spark.createDataFrame(
        [("p", "same", "d1"), ("p", "moved", "d1"), ("p", "undated", None)],
        "product_id string, url string, lastmod string",
    )
    due = {(r.product_id, r.url) for r in discovery.changed_urls(inventory, manifest).collect()}
    assert due == {("p", "moved"), ("p", "undated"), ("q", "same")}
