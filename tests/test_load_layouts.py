"""One load over products whose pages are laid out in different ways."""

import pytest
from pyspark.sql import functions as F

from fixatlas import fixed
from fixatlas.operators import discovery
from fixatlas.plans import load

HEAD = "<table><thead><tr><th>Issue ID</th><th>Description</th></tr></thead><tbody>"


def table(bug_id):
    return f"{HEAD}<tr><td>{bug_id}</td><td>It fails.</td></tr></tbody></table>"


# product, path, page, expected (version, kind) of its one issue
CASES = [
    ("panos", "/pan-os/10-2/pan-os-release-notes/pan-os-10-2-4-known-and-addressed-issues/pan-os-10-2-4-known-issues", table("PAN-1"), ("10.2.4", "known")),
    ("prisma-sdwan", "/prisma-sd-wan/release-notes/prisma-sd-wan-6-1-2-addressed-issues", table("CGSDW-1"), ("6.1.2", "addressed")),
    ("cloud-ngfw-aws", "/cloud-ngfw-aws/release-notes/known-issues", table("FWAAS-1"), (fixed.VERSION_SAAS, "known")),
    ("strata-logging-service", "/strata-logging-service/release-notes/addressed-issues", table("CDL-1"), (fixed.VERSION_SAAS, "addressed")),
    ("adem", "/autonomous-dem/release-notes/known-issues", "<h3>Agent 5.1</h3>" + table("DEM-1"), ("5.1", "known")),
    ("scm", "/strata-cloud-manager/release-notes/known-issues", "<h2>Insights Known Issues</h2>" + table("SCM-1"), (fixed.VERSION_SAAS, "known")),
    ("scm", "/strata-cloud-manager/release-notes/addressed-issues", "<h2>2025.r5.0</h2>" + table("SCM-2"), ("2025.r5.0", "addressed")),
    ("scm", "/sase/prisma-sase-multitenant-platform/release-updates/known-issues-msp", table("SCM-3"), (fixed.VERSION_SAAS, "known")),
    ("prisma-access-agent", "/prisma-access-agent/release-notes/prisma-access-agent-26-2-1-addressed-issues", table("PAA-1"), ("26.2.1", "addressed")),
    ("prisma-access-agent", "/prisma-access-agent/release-notes/addressed-issues", "<h2>Issues Addressed in Prisma Access Agent 26.2.1</h2>" + table("PAA-2"), ("26.2.1", "addressed")),
    ("remote-browser-isolation", "/remote-browser-isolation/release-notes/known-issues", table("RBI-1"), (fixed.VERSION_SAAS, "known")),
    ("plugin-aws", "/plugins/vm-series-and-panorama-plugins-release-notes/panorama-plugin-for-aws/aws-plugin-52/known-issues", table("PLUG-1"), ("5.2.0", "known")),
    ("device-security", "/iot/release-notes/addressed-issues-in-2024", "<h3>Sensors</h3>" + table("IOT-1"), ("2024", "addressed")),
    ("enterprise-dlp", "/enterprise-dlp/release-notes/known-issues-in-enterprise-dlp-plugin-602", table("DLP-1"), ("6.0.2", "known")),
]


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    host = fixed.DOCS_HOST
    inventory = spark.createDataFrame(
        [(host + path, "d1", i) for i, (_, path, _, _) in enumerate(CASES)], "url string, lastmod string, ordinal long"
    )
    none = spark.createDataFrame([], "product_id string, url string, lastmod string")
    where = str(tmp_path_factory.mktemp("load"))
    load.due_by_profile(inventory, none).coalesce(1).write.parquet(f"{where}/due")
    # The index page repeats an issue of a version's own page.
    pages = [(path, 200, 1, html.replace("</tbody>", "<tr><td>PAA-1</td><td>It fails.</td></tr></tbody>") if "PAA-2" in html else html) for _, path, html, _ in CASES]
    spark.createDataFrame(pages, "path string, status int, attempt int, html string").coalesce(1).write.parquet(f"{where}/pages")
    return spark.read.parquet(f"{where}/due"), spark.read.parquet(f"{where}/pages")


@pytest.fixture(scope="module")
def issues(loaded):
    return load.load_all_layouts(*loaded)


@pytest.fixture(scope="module")
def rows(issues):
    return issues.collect()


def test_every_layout_gives_its_issues(rows):
    got = {(r.product_id, r.bug_id, r.version, r.issue_type) for r in rows}
    want = {(p, html.split("<td>")[1].split("<")[0], v, k) for p, _, html, (v, k) in CASES}
    assert got == want and len(rows) == len(CASES)


def test_each_layout_of_the_profiles_is_loaded(spark):
    layouts = {r.layout for r in discovery.extraction_profiles(spark).select("layout").distinct().collect()}
    layouts |= {r.own_layout for r in discovery.page_rules(spark).select("own_layout").collect()}
    assert layouts == set(load._LAYOUTS)


def test_components_of_sections_and_of_the_multitenant_page(rows):
    got = {r.bug_id: r.affected_components for r in rows}
    assert got["SCM-1"] == ["Insights"] and got["SCM-3"] == [fixed.MULTITENANT_COMPONENT]
    assert got["PAN-1"] is None


def test_issues_of_a_versions_own_page_come_before_those_of_the_index_page(rows):
    places = {r.bug_id: r.source_url for r in rows if r.product_id == "prisma-access-agent"}
    assert places["PAA-1"].endswith("26-2-1-addressed-issues") and places["PAA-2"].endswith("/addressed-issues")


def test_bodies_are_not_in_the_plan_of_the_layouts(issues):
    plan = issues._jdf.queryExecution().executedPlan().toString()
    assert "html" not in plan and "MapInArrow" not in plan


def test_books_of_a_load_of_all_layouts(spark, loaded):
    due, pages = loaded
    gone, empty = CASES[0][1], CASES[1][1]
    pages = pages.withColumn("status", F.when(F.col("path") == gone, 404).otherwise(F.col("status")))
    pages = pages.withColumn("html", F.when(F.col("path") == empty, "<p>None.</p>").otherwise(F.col("html")))
    none = spark.createDataFrame([], "product_id string, url string, lastmod string, seq long")
    names = due.selectExpr("product_id", "product_id as product_name").distinct()
    held = spark.createDataFrame([("adem", "A", "5.1", "known", "DEM-0", "Held.")], "product_id string, product_name string, version string, issue_type string, bug_id string, description string")
    for c, kind in (("symptoms", "string"), ("workaround", "string"), ("fix_info", "string"), ("affected_components", "array<string>"), ("release_date", "string"), ("source_url", "string"), ("page_ordinal", "bigint"), ("row_ordinal", "bigint")):
        held = held.withColumn(c, F.lit(None).cast(kind))
    books = load.run(held, none, due, pages, names, 1, all_layouts=True)
    assert {(r.url, r.error) for r in books["failures"].collect()} == {(gone, "gone"), (empty, "no issues found")}
    assert {r.url for r in books["manifest"].collect()} == {fixed.DOCS_HOST + path for _, path, _, _ in CASES if path != gone}
    bugs = {r.bug_id for r in books["issues"].collect()}
    assert "DEM-0" in bugs and "DEM-1" not in bugs and len(bugs) == len(CASES) - 2


def test_unchanged_pages_are_not_due(spark, loaded):
    due, _ = loaded
    rows = due.select("product_id", "url", "lastmod")
    inventory = rows.select("url", "lastmod", F.lit(1).cast("long").alias("ordinal"))
    assert load.due_by_profile(inventory, rows).count() == 0
