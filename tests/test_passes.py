"""How often texts are read: each of these counts was higher when a text was read once for each use."""

import sys

from pyspark.sql import functions as F

from fixatlas.functions import text as tx
from fixatlas.operators import discovery, quality
from fixatlas.sources.html_tree import read_page


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_root_shape_builds_and_parses_each_file_once(spark):
    files = spark.range(3).select("id", F.concat(F.lit('{"products":['), "id", F.lit("]}")).alias("value"))
    df = quality.root_shape(files)
    assert plan(df).count("parseJson") == 2  # a file, and a product in it
    assert [r.problem for r in df.collect()] == ["not an object"] * 3


def test_strict_schema_reads_each_level_once(spark):
    rows = [('{"id":"p","x":1,"versions":[{"version":"1","known_issues":[{"bug_id":"A-1"}]}]}',), ('{"id":"q","name":null,"name":1}',)]
    df = quality.strict_schema(spark.createDataFrame(rows, "value string"))
    assert plan(df).count("jsonObjectKeys") < 6  # twice for a product, a version and an issue before
    found = sorted(tuple(r) for r in df.collect())
    assert found == [("p", "issue", "missing description"), ("p", "product", "missing name"), ("p", "product", "undeclared x")]


def test_a_null_field_that_comes_again_is_still_found(spark):
    rows = [('{"metadata":null,"products":[],"metadata":{"host":1}}',)]
    df = quality.strict_root(spark.createDataFrame(rows, "value string"))
    assert [r.problem for r in df.collect()] == ["undeclared host"]


def test_reading_a_page_takes_few_calls_for_each_cell():
    row = "<tr><td>A-1</td><td>text <i>and</i> more</td></tr>"
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        page = read_page(f"<table>{row * 200}</table>", ("tables",))
    finally:
        sys.setprofile(None)
    assert [c["spaced"] for c in page["tables"][0]["rows"][199]["cells"]] == ["A-1", "text and more"]
    assert calls < 200 * 80


def test_cutting_a_text_searches_it_once(spark):
    texts = ["keep this Workaround: do it", "a  Workaround: b", "none", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select(tx.split_workaround(F.col("text")).alias("w"))
    assert plan(df).count("lower(") == 0 and plan(df).count("regexp_replace(") > 0
    assert [tuple(r.w) for r in df.collect()] == [("keep this", "do it"), ("a ", "b"), ("none", None), (None, None)]


def test_version_of_a_page_is_worked_out_once(spark):
    urls = spark.createDataFrame([("p", "/a/known-issues", 1), ("p", None, 2)], "product_id string, url string, ordinal long")
    df = discovery.version_pages(urls, version=F.regexp_extract("url", "(known)", 1), kinds=F.array(F.lit("known")))
    assert plan(df).count("(known)") == 1
    assert [r.version for r in df.collect()] == ["known"]
