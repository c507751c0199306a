import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from fixatlas.operators import baseline, dedup, merge, quality, releases, report, search
from fixatlas.plans import cards, load
from fixatlas.sources import snapshots, tracker

COLUMNS = (
    "product_id string, product_name string, version string, issue_type string, bug_id string, "
    "description string, symptoms string, workaround string, fix_info string, "
    "affected_components array<string>, release_date string, source_url string, "
    "page_ordinal long, row_ordinal long"
)


@pytest.fixture
def make(spark):
    def run(*rows):
        """Rows of product, version, kind, bug id and optional other fields."""
        out = []
        for n, row in enumerate(rows):
            product, version, kind, bug, *more = row
            d = dict(description=f"about {bug}", page_ordinal=0, row_ordinal=n)
            d.update(more[0] if more else {})
            d.update(product_id=product, product_name=product.upper(), version=version,
                     issue_type=kind, bug_id=bug)
            out.append(tuple(d.get(c.split()[0]) for c in COLUMNS.split(", ")))
        return spark.createDataFrame(out, COLUMNS)

    return run


def test_first_duplicate_wins(make):
    long = "x" * 100
    rows = make(
        ("p", "1", "known", "A-1", {"description": long + "first", "row_ordinal": 5}),
        ("p", "1", "known", "A-1", {"description": long + "second", "row_ordinal": 2}),
        ("p", "1", "known", "A-1", {"description": long + "second", "row_ordinal": 3}),
        ("p", "1", "known", "A-1", {"description": long + "x", "release_date": "d"}),
        ("p", "1", "addressed", "A-1", {"description": long}),
        ("p", "1", "known", "A-1", {"description": "other"}),
    )
    got = dedup.dedup_issues(rows)
    assert got.count() == 5
    both = got.filter(f"description like '{long}%' and issue_type = 'known' and release_date is null")
    assert {(r.description[100:], r.row_ordinal) for r in both.collect()} == {("first", 5), ("second", 2)}


def test_hot_duplicates_are_cut_before_the_shuffle(make):
    plan = dedup.dedup_issues(make(("p", "1", "known", "A-1")))._jdf.queryExecution().toString()
    physical = plan[plan.index("Physical Plan"):]
    assert physical.index("Final") < physical.index("Exchange") < physical.index("Partial")


def test_merge_keeps_existing_versions_and_names(make):
    old = make(("p", "1", "known", "A-1"), ("p", "2", "known", "A-2"))
    new = make(("p", "2", "known", "A-9"), ("p", "3", "known", "A-3"), ("q", "1", "known", "A-4"))
    new = new.withColumn("product_name", F.lit("renamed"))
    got = {(r.product_id, r.version, r.bug_id, r.product_name) for r in merge.merge_issues(old, new).collect()}
    assert got == {
        ("p", "1", "A-1", "P"), ("p", "2", "A-2", "P"), ("p", "3", "A-3", "P"), ("q", "1", "A-4", "renamed"),
    }
    changed = merge.merge_issues(old, new, replace_changed=True)
    assert {r.bug_id for r in changed.collect()} == {"A-1", "A-9", "A-3", "A-4"}


def test_index_issues_join_their_version(make):
    own = make(("p", "1", "addressed", "A-1"))
    index = make(("p", "1", "addressed", "A-1"), ("p", "1", "addressed", "A-2"), ("p", "9", "addressed", "A-3"))
    got = {(r.version, r.bug_id) for r in merge.merge_index_issues(own, index).collect()}
    assert got == {("1", "A-1"), ("1", "A-2"), ("9", "A-3")}


def test_release_joins(make):
    rows = make(
        ("p", "1.0", "known", "A-1"), ("p", "1.0", "known", "A-1"), ("p", "2.0", "known", "A-1"),
        ("p", "10.0", "addressed", "A-1"), ("p", "9.0-h2", "addressed", "A-1"), ("p", "9.0-h2", "addressed", "A-1"),
        ("q", "1.0", "known", "A-1"),
    )
    known = rows.filter("issue_type = 'known'")
    fixes = {(r.product_id, r.version, r.n_fixes, r.newest_fix) for r in releases.with_fixes(known, rows).collect()}
    assert fixes == {("p", "1.0", 3, "10.0"), ("p", "2.0", 3, "10.0"), ("q", "1.0", 0, None)}
    others = {(r.product_id, r.version, r.n_others, r.newest_other) for r in releases.also_affected(known, rows).collect()}
    assert others == {("p", "1.0", 1, "2.0"), ("p", "2.0", 2, "1.0"), ("q", "1.0", 0, None)}
    asked = known.filter("product_id = 'p' and version = '1.0'").limit(1)
    listed = releases.release_list(asked, releases.known_releases(rows), other_than_own=True)
    assert [(r.listed_version, r.n) for r in listed.collect()] == [("2.0", 1)]


def test_release_joins_survive_a_hot_bug(spark):
    """A third of all rows is one bug: result stays linear and counts stay exact."""
    rows = spark.range(30000).select(
        F.lit("p").alias("product_id"),
        F.when(F.col("id") % 3 == 0, "HOT-1").otherwise(F.concat(F.lit("A-"), F.col("id"))).alias("bug_id"),
        F.concat(F.lit("1."), F.col("id") % 10).alias("version"),
        F.lit("known").alias("issue_type"),
    )
    out = releases.also_affected(rows, rows)
    assert out.count() == 30000
    assert out.filter("bug_id = 'HOT-1'").agg(F.min("n_others"), F.max("n_others")).first() == (9000, 9000)


def test_other_releases_sort_once(make):
    """A window for each expression would hold the rows of a task four times."""
    out = releases.other_releases(make(("p", "1.0", "known", "A-1")))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert sum(line.lstrip(" +-:").startswith("Window [") for line in plan.splitlines()) == 1


def test_search_and_paging(make):
    rows = make(
        ("p", "1", "known", "A-1", {"description": "Alpha", "affected_components": ["Beta"]}),
        ("p", "1", "addressed", "A-2", {"description": "alpha", "fix_info": "beta"}),
        ("q", "1", "known", "A-3", {"description": "x", "workaround": "ALPHA"}),
    )
    assert search.search(rows, "ALPHA beta").count() == 1
    assert search.search(rows, "alpha").count() == 3
    assert search.search(rows, "alpha", product="p", issue_type="known").count() == 1
    assert search.search(rows).count() == 3
    assert search.search(rows.withColumn("search_text", F.lit("zeta")), "Zeta").count() == 3
    order = ["bug_id"]
    assert [r.bug_id for r in search.page_slice(rows, order, page=2, size=2).collect()] == ["A-3"]
    assert [r.bug_id for r in search.page_slice(rows, order, page=9, size=2).collect()] == ["A-3"]
    assert search.page_slice(rows.limit(0), order, page=1, size=2).count() == 0
    assert search.page_slice(rows, order, page=1, size=None).count() == 3
    assert [r.bug_id for r in search.page_after(rows, order, ["A-1"], 1).collect()] == ["A-2"]


def test_page_strip(spark):
    def strip(current, total):
        df = spark.createDataFrame([(current, total)], "c long, t long")
        return " ".join(df.select(search.page_strip(F.col("c"), F.col("t"))).first()[0])

    assert strip(1, 3) == "1 2 3"
    assert strip(1, 7) == "1 2 3 4 5 6 7"
    assert strip(1, 20) == "1 2 ... 20"
    assert strip(4, 20) == "1 ... 3 4 5 ... 20"
    assert strip(18, 20) == "1 ... 17 18 19 20"
    assert strip(20, 20) == "1 ... 19 20"


def test_cards(make):
    rows = make(("p", "SaaS", "known", "A-1"), ("p", "2.0", "addressed", "A-1"))
    got = {r.issue_type: r for r in cards.result_page(rows).collect()}
    assert got["known"].label == "P" and got["known"].fix_available
    assert got["addressed"].label == "P 2.0" and not got["addressed"].fix_available


def test_a_page_past_the_end_counts_only_issues_with_a_place(make):
    rows = make(*(("p", "1", "known", f"A-{i}") for i in range(4)), *(("p", None, "known", f"B-{i}") for i in range(3)))
    assert cards.shown_at_all(rows).count() == cards.placed(rows).count() == 4
    assert {r.bug_id for r in cards.result_page(rows, page=9, size=2).collect()} == {"A-2", "A-3"}


def test_snapshot_diff(make):
    old = make(
        ("gone", "1", "known", "A-1"), ("p", "1", "known", "A-1"), ("p", "1", "known", "A-2"),
        ("p", "2", "known", "A-3"), ("p", "4", "addressed", ""),
    )
    new = make(("new", "1", "known", "A-1"), ("p", "1", "known", "A-1"), ("p", "3", "known", "A-4"), ("p", "4", "addressed", ""))
    tables = [f(x) for f in (baseline.fingerprint, baseline.bug_ids) for x in (old, new)]
    deltas = baseline.diff(*tables)
    got = {(r.delta_kind, r.product_id, r.version, r.before_n, r.after_n, r.bug_id) for r in deltas.collect()}
    assert got == {
        ("product_added", "new", None, None, None, None), ("product_removed", "gone", None, None, None, None),
        ("version_added", "p", "3", None, None, None), ("version_removed", "p", "2", None, None, None),
        ("count_regression", "p", "1", 2, 1, None), ("missing_ids", "p", "1", 1, None, None),
        ("missing_id", "p", "1", None, None, "A-2"),
    }
    assert not baseline.verdict(deltas).first().is_clean
    grown = [f(x) for f in (baseline.fingerprint, baseline.bug_ids) for x in (new, new.union(old))]
    assert baseline.verdict(baseline.diff(*grown)).first().is_clean


def test_all_missing_ids_are_reported_and_ten_shown(make):
    old = make(("p", "1", "known", "B"), *[("p", "1", "known", f"A-{n:03}") for n in range(25)])
    new = make(("p", "1", "known", "B"))
    deltas = baseline.diff(*[f(x) for f in (baseline.fingerprint, baseline.bug_ids) for x in (old, new)])
    assert deltas.filter("delta_kind = 'missing_id'").count() == 25
    assert deltas.filter("delta_kind = 'missing_ids'").first().before_n == 25
    shown = baseline.missing_id_samples(deltas).first()
    assert shown["items"] == [f"A-{n:03}" for n in range(10)] and shown.more == 15


def test_diff_reads_each_snapshot_twice_at_most(spark, make, tmp_path):
    paths = [str(tmp_path / x) for x in "ab"]
    for path in paths:
        snapshots.save_baseline(make(("p", "1", "known", "A-1")), path)
    (a, ai), (b, bi) = (snapshots.load_baseline(spark, p) for p in paths)
    plan = baseline.diff(a, b, ai, bi)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(" parquet") <= 5 and plan.count("FullOuter") == 1


def test_digests_do_not_depend_on_order_and_can_be_merged(make):
    ids = [("p", v, "known", f"{v}-{n}") for v in "123" for n in range(40)]
    whole = baseline.digests(baseline.bug_ids(make(*ids, ("p", "4", "known", ""))))
    rows = sorted(tuple(r) for r in whole.collect())
    again = baseline.digests(baseline.bug_ids(make(*reversed(ids)).repartition(5)))
    parts = [baseline.digests(baseline.bug_ids(make(*ids[k::3]))) for k in range(3)]
    merged = baseline.merged_digests(parts[0].union(parts[1]).union(parts[2]))
    assert len(rows) == 3 and rows == sorted(tuple(r) for r in again.collect()) == sorted(tuple(r) for r in merged.collect())
    # As many identifiers, one of them another.
    other = baseline.digests(baseline.bug_ids(make(*ids[:-1], ("p", "3", "known", "3-x"))))
    assert [tuple(r) for r in baseline.changed_versions(whole, other).collect()] == [("p", "3")]


def test_pruned_diff_equals_the_whole_and_leaves_unchanged_versions(spark, make, tmp_path):
    rows = [("p", str(v), "known", f"A-{n}") for v in range(20) for n in range(v + 1)] + [("p", "none", "known", "")]
    new = [r for r in rows if r[1] not in ("3", "18") or r[3] != "A-1"] + [("p", "5", "addressed", "B"), ("q", "1", "known", "C")]
    new = [r if r[:2] != ("p", "7") else ("p", "7", "known", "") for r in new] + [("p", "none", "known", "D")]
    paths = [str(tmp_path / x) for x in "ab"]
    for path, part in zip(paths, (rows, new)):
        snapshots.save_baseline(make(*part), path)
    (a, ai), (b, bi) = (snapshots.load_baseline(spark, p) for p in paths)
    da, db = (snapshots.load_digests(spark, p) for p in paths)
    assert a.columns == ["product_id", "version", "known", "addressed", "n_bug_ids"]
    assert sorted(map(tuple, da.collect())) == sorted(map(tuple, baseline.digests(ai).collect()))
    whole, pruned = baseline.diff(a, b, ai, bi), baseline.diff(a, b, ai, bi, da, db)
    assert sorted(map(str, whole.collect())) == sorted(map(str, pruned.collect()))
    assert {r.bug_id for r in pruned.filter("delta_kind = 'missing_id'").collect()} == {"A-1"}
    changed = baseline.changed_versions(da, db)
    assert sorted(r.version for r in changed.collect()) == ["18", "3", "5"]
    # Identifiers meet the short list before they are shuffled.
    plan = baseline.missing_ids(ai, bi, changed)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin [product_id") >= 2 and "LeftSemi" in plan


def test_parity(make):
    old = make(*[("p", "1", "known", f"A-{n}") for n in range(4)], ("p", "2", "addressed", "A-1"))
    new = make(*[("p", "1", "known", f"A-{n}") for n in range(2)], ("p", "3", "known", "A-1"))
    f = baseline.fingerprint
    assert {(r.version, r.issue_type) for r in baseline.parity(f(old), f(new)).collect()} == {
        ("1", "known"), ("2", "addressed"),
    }
    assert {r.version for r in baseline.parity(f(old), f(new), 0.5).collect()} == {"2"}


def test_baseline_of_another_format_is_refused(spark, make, tmp_path):
    path = str(tmp_path / "b")
    snapshots.save_baseline(make(("p", "1", "known", "A-1")), path)
    counts, _ = snapshots.load_baseline(spark, path)
    assert counts.count() == 1
    counts.withColumn("schema_version", F.lit(2)).write.parquet(str(tmp_path / "c" / "counts"))
    counts.withColumn("schema_version", F.lit(2)).write.parquet(str(tmp_path / "c" / "ids"))
    with pytest.raises(PySparkException, match="schema_version 2"):
        snapshots.load_baseline(spark, str(tmp_path / "c"))[0].collect()


def test_manifest_starts_empty(spark, tmp_path):
    assert snapshots.load_manifest(spark, str(tmp_path / "none")).count() == 0


def test_tracker_file_and_report_file(spark, tmp_path):
    issue = {"bug_id": "A-1", "description": "d"}
    doc = {"metadata": {"version": "1.0.0"}, "products": [
        {"id": "p", "name": "P", "versions": [{"version": "1", "known_issues": [], "addressed_issues": [issue]},
                                              {"version": "2"}]}]}
    path = tmp_path / "t.json"
    path.write_text(json.dumps(doc, indent=1))
    rows = tracker.flatten_issues(tracker.read_tracker_file(spark, str(path))).collect()
    assert [(r.version, r.issue_type, r.bug_id) for r in rows] == [("1", "addressed", "A-1")]
    rep = tmp_path / "r.json"
    rep.write_text(json.dumps({"failed_fetches": [{"url": "u", "error": "e", "product": "p"}]}, indent=1))
    assert tracker.read_report_file(spark, str(rep)).first()[:3] == ("u", "e", "p")


def test_nested_parts_are_bounded_and_flatten_back(make):
    rows = make(*[("p", "1", "known", f"A-{n}", {"page_ordinal": n}) for n in range(10)])
    nested = tracker.nest_versions(rows, pages_per_part=4)
    assert sorted(len(r.known_issues) for r in nested.collect()) == [2, 4, 4]
    flat = tracker.flatten_issues(tracker.to_documents(nested)).orderBy("version_no", "part", "kind_rank", "row_ordinal")
    assert [r.bug_id for r in flat.collect()] == [f"A-{n}" for n in range(10)]


def test_fetch_report_counts_only_this_load(make, spark):
    rows = make(("p", "1", "known", "A-1"), ("p", "2", "addressed", "A-1"), ("q", "1", "known", "A-2"))
    log = spark.createDataFrame([("p", "e"), ("p", None), ("r", "e")], "product_id string, error string")
    products = spark.createDataFrame([("p",), ("q",), ("s",)], "product_id string")
    got = {r.product_id: tuple(r)[1:] for r in report.fetch_report(rows, log, products).collect()}
    # One product only failed and is in no list; its failure counts all the same.
    assert got == {
        "p": (2, 1, 1, 1, ["1", "2"]), "q": (1, 1, 0, 0, ["1"]), "r": (0, 0, 0, 1, []), "s": (0, 0, 0, 0, []),
        None: (3, 2, 1, 2, None),
    }


def test_strict_schema(spark):
    doc = {"id": "p", "name": "P", "x": 1, "versions": [{"version": "1", "y": 1, "known_issues": [{"bug_id": "A"}]}]}
    df = spark.createDataFrame([(json.dumps(doc),)], "value string")
    got = {(r.level, r.problem) for r in quality.strict_schema(df).collect()}
    assert got == {("product", "undeclared x"), ("version", "undeclared y"), ("issue", "missing description")}


def test_load_end_to_end(spark, make):
    """Inventory to merged issues: gate, landing page, failed page, existing version."""
    base = "https://docs.paloaltonetworks.com/globalprotect/release-notes/6-2/"
    inventory = spark.createDataFrame(
        [
            (base + "gp-6-2-1/known-and-addressed-issues", "d1", 1), (base + "gp-6-2-1-known-issues", "d1", 2),
            (base + "gp-6-2-2-known-issues", "d1", 3), (base + "gp-6-2-3-addressed-issues", "d1", 4),
            (base + "overview", "d1", 5),
        ],
        "url string, lastmod string, ordinal long",
    )
    manifest = spark.createDataFrame(
        [("globalprotect", base + "gp-6-2-2-known-issues", "d1")], "product_id string, url string, lastmod string"
    )
    due = load.due_pages(inventory, manifest)
    table = "<table><tr><th>Issue ID</th><th>Description</th></tr><tr><td>GPC-1</td><td>Fails</td></tr></table>"
    prefix = "/globalprotect/release-notes/6-2/"
    pages = spark.createDataFrame(
        [(prefix + "gp-6-2-1-known-issues", 200, 1, table), (prefix + "gp-6-2-3-addressed-issues", 500, 1, ""),
         (prefix + "gp-6-2-3-addressed-issues", 200, 2, table), (prefix + "gp-6-2-2-known-issues", 200, 1, table)],
        "path string, status int, attempt int, html string",
    )
    names = spark.createDataFrame([("globalprotect", "Client")], "product_id string, product_name string")
    held = make(("globalprotect", "6.2.1", "known", "GPC-9"))
    plan = load.load_issues(due, pages)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("MapInArrow"):]
    # Bodies meet the stored choice where they are read: nothing that holds them is shuffled.
    for line in below.splitlines():
        if "Exchange hashpartitioning" in line:
            assert "attempt" not in line
    got = {(r.version, r.issue_type, r.bug_id, r.product_name) for r in load.refresh(held, due, pages, names).collect()}
    assert got == {
        ("6.2.1", "known", "GPC-9", "GLOBALPROTECT"), ("6.2.3", "addressed", "GPC-1", "GLOBALPROTECT"),
    }


def test_load_with_its_books(spark, make):
    """Every due page is either in the manifest or among the failures that keep it due."""
    due = spark.createDataFrame(
        [("p", "1", "known", "/a", 1, "u/a", "d2"), ("p", "1", "addressed", "/gone", 2, "u/gone", "d1"),
         ("p", "2", "known", "/flaky", 3, "u/flaky", None), ("p", "2", "known", "/never", 4, "u/never", "d1"),
         ("q", "1", "known", "/empty", 5, "u/empty", "d1")],
        "product_id string, version string, kind string, path string, ordinal long, url string, lastmod string",
    )
    table = "<table><tr><th>Issue ID</th><th>Description</th></tr>" + "".join(
        f"<tr><td>GPC-{n}</td><td>Fails</td></tr>" for n in (3, 1, 2)) + "</table>"
    pages = spark.createDataFrame(
        [("/a", 200, 1, "<table></table>"), ("/a", 200, 2, table), ("/a", 500, 3, ""), ("/gone", 404, 1, ""), ("/flaky", 503, 1, ""),
         ("/empty", 200, 1, "<p>nothing</p>"), ("/other", 200, 1, table)],
        "path string, status int, attempt int, html string",
    )
    manifest = spark.createDataFrame([("p", "u/a", "d1", 1)], "product_id string, url string, lastmod string, seq long")
    names = spark.createDataFrame([("p", "P")], "product_id string, product_name string")
    books = load.run(make(("p", "9", "known", "OLD-1")), manifest, due, pages, names, seq=2)
    new = [r for r in books["issues"].collect() if r.bug_id != "OLD-1"]
    assert [r.bug_id for r in sorted(new, key=lambda r: r.row_ordinal)] == ["GPC-3", "GPC-1", "GPC-2"]
    assert {(r.url, r.lastmod) for r in books["manifest"].collect()} == {("u/a", "d2"), ("u/empty", "d1")}
    assert {(r.url, r.error) for r in books["failures"].collect()} == {
        ("/gone", "gone"), ("/flaky", "transient"), ("/never", "not captured"), ("/empty", "no issues found"),
    }
    report_rows = {r.product_id: (r.versions, r.known, r.failed) for r in books["report"].collect()}
    assert report_rows == {"p": (1, 3, 3), "q": (0, 0, 1), None: (1, 3, 4)}


def test_document_order_of_versions(make):
    from fixatlas.plans import cards

    rows = make(*[("p", v, k, f"{v}-{k}", {"page_ordinal": 1}) for v in ("9.1.0", "10.1.0", "11.0.0") for k in ("addressed", "known")],
                ("a", "1", "known", "first"))
    placed = cards.numbered(cards.placed(rows))
    got = [r.bug_id for r in search.page_slice(placed, cards.KEYSET, 1).collect()]
    assert got == ["first", *[f"{v}-{k}" for v in ("11.0.0", "10.1.0", "9.1.0") for k in ("known", "addressed")]]
    walked, last = [], None
    while page := search.page_after(placed, cards.KEYSET, last, 3).select("bug_id", *cards.KEYSET).collect():
        walked += [r.bug_id for r in page]
        last = list(page[-1])[1:]
    assert walked == got


def test_pages_cut_inside_ties_lose_no_row(make):
    from fixatlas.plans import cards

    nowhere = {"page_ordinal": None, "row_ordinal": None}
    rows = make(*[("p", "1", "known", f"B-{n}", nowhere) for n in range(7)], *[("p", "1", "known", "same", nowhere)] * 4)
    placed, walked, last = cards.numbered(cards.placed(rows)), [], None
    while page := search.page_after(placed, cards.KEYSET, last, 3).select("bug_id", *cards.KEYSET).collect():
        walked += [r.bug_id for r in page]
        last = list(page[-1])[1:]
    assert sorted(walked) == sorted([f"B-{n}" for n in range(7)] + ["same"] * 4)


def test_tracker_is_written_compressed_and_read_back(spark, tmp_path):
    from fixatlas.sources import tracker
    from fixatlas.workloads.derived import issues

    path = str(tmp_path / "tracker")
    rows = issues(spark, "/root/testdata/sf0.001")
    tracker.write_tracker(rows, path)
    read = tracker.read_tracker(spark, path)
    assert all(f.endswith(".json.gz") for f in read.inputFiles())
    names = ["product_id", "version", "issue_type", "bug_id", "description", "workaround"]
    got, want = tracker.flatten_issues(read).select(*names), rows.select(*names)
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()


def test_dedup_carries_each_text_once(spark):
    """Null and empty texts are one issue, the first row's text comes back, and no second text is shuffled."""
    schema = "product_id string, version string, issue_type string, bug_id string, release_date string, description string, page_ordinal long, row_ordinal long"
    key = ("p", "1", "known", "A-1", None)
    rows = spark.createDataFrame([(*key, "", 0, 2), (*key, None, 0, 1), (*key, "x", 1, 1), (*key, "x", 0, 3)], schema)
    out = dedup.dedup_issues(rows)
    assert sorted(((r.description, r.row_ordinal) for r in out.collect()), key=str) == [("x", 3), (None, 1)]
    assert out.columns == rows.columns
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "_w0" not in plan and "_w1" not in plan
