"""A load works its list of due pages out once."""

from pyspark.sql import functions as F

from fixatlas.plans import load


def test_books_read_the_stored_work_list(spark):
    due = spark.createDataFrame(
        [("p", "1", "known", "/a", 1, "u/a", "d1"), ("p", "1", "known", "/gone", 2, "u/gone", "d1")],
        "product_id string, version string, kind string, path string, ordinal long, url string, lastmod string",
    ).withColumn("url", F.concat("url", F.when(F.rand() < 2, "#worked-out")))
    table = "<table><tr><th>Issue ID</th><th>Description</th></tr><tr><td>GPC-1</td><td>Fails</td></tr></table>"
    pages = spark.createDataFrame(
        [("/a", 200, 1, table), ("/gone", 404, 1, "")], "path string, status int, attempt int, html string"
    )
    none = spark.createDataFrame([], "product_id string, url string, lastmod string, seq long")
    names = spark.createDataFrame([("p", "P")], "product_id string, product_name string")
    held = load.load_issues(due, pages).limit(0).withColumn("product_name", F.lit(""))
    books = load.run(held, none, due, pages, names, 1)
    for name in ("manifest", "failures", "report"):
        assert "#worked-out" not in books[name]._jdf.queryExecution().optimizedPlan().toString()
    assert [r.url for r in books["manifest"].collect()] == ["u/a#worked-out"]
    assert [r.url for r in books["failures"].collect()] == ["/gone"]
