import time

import pytest
from pyspark.sql import functions as F

from fixatlas.operators import extract
from fixatlas.sources.html_tree import read_page
from fixatlas.sources.pages import latest_attempts, parse_pages, usable_pages, valid_landing_pages

ALL = ("title", "headings", "links", "tables", "topics", "aria")


def issues(spark, html, fn, *parts):
    df = spark.createDataFrame([("u", html)], "url string, html string")
    rows = fn(parse_pages(df, *parts)).collect()
    return [r.asDict() for r in rows]


def ids(rows):
    return [r["bug_id"] for r in rows]


def table(*rows, head="<tr><th>Issue ID</th><th>Description</th></tr>"):
    body = "".join(f"<tr><td>{a}</td><td>{b}</td></tr>" for a, b in rows)
    return f"<table>{head}{body}</table>"


# --- reading markup ---------------------------------------------------------------------


def test_unclosed_cells_paragraphs_and_raw_text():
    page = read_page(
        "<title>A &amp; B</title><script>'<table><p>'</script><p>one <b>two<p>three"
        "<table><tr><td>a<td>b<tr><td>c</table><!-- <h1>no</h1> --><h1>yes</h1>", ALL,
    )
    assert page["title"] == "A & B"
    assert [h["spaced"] for h in page["headings"]] == ["one two", "three", "yes"]
    assert [[c["fused"] for c in r["cells"]] for r in page["tables"][0]["rows"]] == [["a", "b"], ["c"]]


def test_end_tag_does_not_leave_its_cell():
    page = read_page("<div><table><tr><td>a</div>b</td><td>c</td></tr></table>d</div>", ALL)
    assert [c["spaced"] for c in page["tables"][0]["rows"][0]["cells"]] == ["a b", "c"]


def test_sections_and_nested_tables():
    page = read_page(
        "<table><thead><tr><th>H</th></tr></thead><tbody><tr><td>x<table><tbody><tr><td>1</td><td>2"
        "</td></tr></tbody></table>y</td></tr></tbody><tbody><tr><td>z</td></tr></tbody></table>", ALL,
    )
    assert len(page["tables"]) == 1
    rows = page["tables"][0]["rows"]
    assert [r["section"] for r in rows] == ["thead", "tbody 1", "tbody 2"]
    assert rows[1]["cells"][0]["spaced"] == "x [1: 2] y"
    assert rows[1]["cells"][0]["fused"] == "x12y"


@pytest.mark.parametrize(
    "html", ["", "text", "<", "<a", "<a href='x", "<p" * 2000, "</td></div>", "<b>" * 5000 + "x", "<!--"]
)
def test_broken_markup_is_read_somehow(html):
    assert read_page(html, ALL)["tables"] == []


def test_null_page_gives_nulls(spark):
    df = spark.createDataFrame([("u", None)], "url string, html string")
    assert parse_pages(df, "title", "tables").first() == ("u", None, None)


def test_attempts(spark):
    df = spark.createDataFrame(
        [("a", 200, 1), ("a", 503, 2), ("b", 404, 1), ("b", 500, 2), ("c", 200, 1), ("c", 200, 2)],
        "url string, status int, attempt int",
    )
    got = {(r.url, r.attempt, r.outcome) for r in latest_attempts(df).collect()}
    assert got == {("a", 1, "usable"), ("b", 2, "transient"), ("c", 2, "usable")}
    assert usable_pages(df).count() == 2


def test_landing_pages(spark):
    df = spark.createDataFrame(
        [(1, "<title>Notes</title><h1>x</h1>"), (2, "<title>404</title><h1>x</h1>"), (3, "<h2>x</h2>")],
        "id int, html string",
    )
    assert [r.id for r in valid_landing_pages(parse_pages(df, "title", "headings")).collect()] == [1]


# --- tables -----------------------------------------------------------------------------


def test_header_choice(spark):
    # The last header with issue, bug or id is the id column, and "Did" contains "id".
    html = (
        "<table><tr><th>Bug</th><th>Did it</th><th>Summary</th><th>Issue Description</th></tr>"
        "<tr><td>AB-1</td><td>AB-2</td><td>s</td><td>AB-3</td></tr></table>"
    )
    rows = issues(spark, html, extract.issue_tables, "tables")
    assert [(r["bug_id"], r["description"]) for r in rows] == [("AB-3", "s")]


def test_tables_without_ids_headers_or_width_give_nothing(spark):
    html = (
        table(("AB-1", "x"), head="<tr><th>Name</th><th>Description</th></tr>")
        + "<table><tr><th>Issue</th><th>Description</th></tr><tr><td>AB-2</td></tr></table>"
        + table(("none", "x"), ("AB-3", "y"))
        + "<table></table><table><thead></thead><tr><td>AB-4</td></tr></table>"
    )
    assert ids(issues(spark, html, extract.issue_tables, "tables")) == ["AB-3"]


def test_td_header_only_where_allowed(spark):
    html = "<table><tr><td><b>ISSUE ID</b></td><td>Description</td></tr><tr><td>AB-1</td><td>x</td></tr></table>"
    assert ids(issues(spark, html, extract.issue_tables, "tables")) == ["AB-1"]
    got = issues(spark, html, lambda p: extract.feature_tables(p, F.lit("f")), "tables")
    assert got == []


def test_only_the_first_body_counts(spark):
    html = (
        "<table><thead><tr><th>ID</th></tr></thead><tbody><tr><td>AB-1</td></tr></tbody>"
        "<tbody><tr><td>AB-2</td></tr></tbody></table>"
    )
    assert ids(issues(spark, html, extract.issue_tables, "tables")) == ["AB-1"]


def test_row_rules(spark):
    html = table(
        ('<div class="p">AB-100</div><div class="p">AB-200</div>',
         "(One) Fails. This issue is resolved in 9.1. Workaround: w"),
        ("AB-300<br>Resolved in 8", "Fails. This issue is resolved in 9.1."),
    )
    got = issues(spark, html, extract.issue_tables, "tables")
    assert [(r["bug_id"], r["description"], r["workaround"], r["fix_info"], r["affected_components"]) for r in got] == [
        ("AB-100", "Fails.", "w", "Resolved in 9.1", ["One"]),
        ("AB-200", "Fails.", "w", "Resolved in 9.1", ["One"]),
        ("AB-300", "Fails. This issue is resolved in 9.1.", None, "Resolved in 8", None),
    ]


# --- topics -----------------------------------------------------------------------------

TOPIC = '<div class="topic"><h2 class="title">{}</h2>{}</div>'


def test_topic_rules(spark):
    html = TOPIC.format("AB-1", (
        '<div class="shortdesc">Description of ab-1: Short.</div><div class="p">( Linux ) First.</div>'
        '<div class="p">(kept) Second.</div><div class="p"><b>Workaround</b></div>'
        '<div class="p">After a bare marker: nowhere.</div>'
        '<div class="p">This issue is fixed in 5.1.</div>'
    )) + TOPIC.format("AB-2", '<div class="p"></div>') + TOPIC.format("Title", '<div class="p">x</div>')
    got = issues(spark, html, extract.topic_pages, "topics")
    assert [(r["bug_id"], r["description"], r["workaround"], r["fix_info"], r["affected_components"]) for r in got] == [
        ("AB-1", "Short. First. (kept) Second.", None, "This issue is fixed in 5.1.", ["Linux"]),
    ]


def test_wrapper_topic_does_not_borrow_its_child(spark):
    html = '<div class="topic"><h1>All</h1>' + TOPIC.format("AB-1", '<div class="p">x</div>') + "</div>"
    assert ids(issues(spark, html, extract.topic_pages, "topics")) == ["AB-1"]


def test_topics_only_without_table_issues(spark):
    topic = TOPIC.format("AB-1", '<div class="p">x</div>')
    both = issues(spark, table(("AB-2", "y")) + topic, extract.issue_pages, "tables", "topics")
    assert ids(both) == ["AB-2"]
    alone = issues(spark, table(("none", "y")) + topic, extract.issue_pages, "tables", "topics")
    assert [(r["bug_id"], r["description"]) for r in alone] == [("AB-1", "x")]


def test_fix_versions(apply):
    assert apply(lambda c: extract.fix_versions(c), [
        "Addressed in 3.0.7, 3.0.7 and 3.1-h2; needs 11.1.4.", "later", None,
    ]) == [["3.0.7", "3.1-h2"], [], []]


# --- sections ---------------------------------------------------------------------------


def test_dates_hold_until_the_next_version(spark):
    html = (
        table(("AB-1", "x")) + "<h3>Agent 5.1</h3><p>March 2024</p>" + table(("AB-2", "x"))
        + "<h4>April 5, 2024</h4>" + table(("AB-3", "x")) + "<h3>Agent 5.2</h3>" + table(("AB-4", "x"))
    )
    def dates(kind):
        fn = lambda p: extract.sections_by_agent_version(p, F.lit(kind))
        return [(r["version"], r["release_date"]) for r in issues(spark, html, fn, "headings", "tables")]
    assert dates("addressed") == [
        ("Unknown", None), ("5.1", "2024-03-01"), ("5.1", "2024-04-05"), ("5.2", None),
    ]
    assert {d for _, d in dates("known")} == {None}


def test_date_heading_makes_the_version_unknown(spark):
    html = (
        "<h2>2025.r5.0</h2><h3>Insights</h3>" + table(("AB-1", "x")) + "<h2>May 2025</h2>"
        + table(("AB-2", "x")) + "<h2>2025.r6.0</h2>" + table(("AB-3", "(Own) x"))
        + "<table><tr><td>AB-4<br>2025.r1.0</td><td>y</td></tr></table>"
    )
    got = issues(spark, html, extract.sections_by_calendar_version, "headings", "tables")
    assert [(r["bug_id"], r["version"], r["release_date"], r["affected_components"]) for r in
            sorted(got, key=lambda r: r["bug_id"])] == [
        ("AB-1", "2025.r5.0", None, ["Insights"]), ("AB-2", "Unknown", "2025-05-01", ["Insights"]),
        ("AB-3", "2025.r6.0", None, ["Own"]), ("AB-4", "2025.r1.0", None, None),
    ]


def test_kind_heading_speaks_for_the_page(spark):
    html = (
        table(("AB-1", "x")) + "<h2>TS Agent 11.0.2 Addressed Issues</h2>" + table(("AB-2", "x"))
        + "<h3>Features</h3>" + table(("AB-3", "x")) + "<h2>Known Issues</h2>" + table(("AB-4", "x"))
    )
    fn = lambda p: extract.sections_by_version_and_kind(p, F.lit("/t-release-information-11-1"))
    got = issues(spark, html, fn, "headings", "tables")
    assert [(r["version"], r["issue_type"]) for r in got] == [
        ("11.1", "known"), ("11.0.2", "addressed"), ("11.0.2", "addressed"), ("11.1", "known"),
    ]


def test_long_pages_with_many_marks(spark):
    """Context is found once for a table, so rows and marks of a page don't multiply."""
    n = 4_000
    rows = "".join(f"<tr><td>ADEM-{i}</td><td>Fails</td></tr>" for i in range(n))
    html = "<h2>Agent 5.1</h2>" + "<p>Some text</p>" * n + "<p>May 2024</p><table><tr><th>Issue ID</th><th>Description</th></tr>" + rows + "</table>"
    page = spark.createDataFrame([("u", html)], "url string, html string")
    found = extract.sections_by_agent_version(parse_pages(page, "headings", "tables"), F.lit("addressed"))
    start = time.time()
    assert found.filter("version = '5.1'").count() == n
    assert time.time() - start < 60


def test_raw_title_is_the_text_as_written(spark):
    """A title cut inside an entity, or with spaces, does not come back from its decoded text."""
    from fixatlas.sources.pages import parse_pages

    html = ["<title> a &amp b  &lt; &am</title><p>x", "<!-- <title>no</title> --><TITLE>&amp;</TITLE>", "<p>none", None]
    given = spark.createDataFrame(list(enumerate(html)), "page_id int, html string")
    got = {r.page_id: r.raw_title for r in parse_pages(given, "raw_title").collect()}
    assert got == {0: " a &amp b  &lt; &am", 1: "&amp;", 2: None, 3: None}
    both = parse_pages(given, "raw_title", "title").filter("page_id = 0").first()
    assert (both.raw_title, both.title) == (" a &amp b  &lt; &am", "a & b < &am")


def test_pages_without_issues_take_one_pass(spark):
    """The pages of the anti join, without cleaning texts or reading pages twice."""
    from fixatlas.operators import quality

    html = [
        table(("PAN-1", "a")), table(("None", "b")), table(("None", "b"), ("PAN-2 and PAN-3", "c")), "<p>no table",
        table(("PAN-4", "d"), head="<tr><th>Feature</th></tr>"), table(), None,
    ]
    given = spark.createDataFrame([(str(i), h) for i, h in enumerate(html)], "url string, html string")
    parsed = parse_pages(given, "tables")
    out = extract.without_issue_tables(parsed)
    old = quality.pages_without_issues(given.select("url"), extract.issue_tables(parsed))
    assert {r.url for r in out.collect()} == {r.url for r in old.collect()} == {"1", "3", "4", "5", "6"}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan
