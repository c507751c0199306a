"""Paging by position and search by letter triples over a stored catalog."""

import pytest

from fixatlas.operators import search
from fixatlas.plans import cards, catalog
from fixatlas.workloads.derived import issues

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    # Every tenth row twice and one row very often: equal rows have places of their own.
    all_rows = issues(spark, DATA)
    twice = all_rows.where("row_ordinal % 10 = 0")
    often = all_rows.limit(1).crossJoin(spark.range(500)).drop("id")
    return all_rows.unionByName(twice).unionByName(often).cache()


@pytest.fixture(scope="module")
def path(rows, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("catalog") / "c")
    catalog.write_catalog(rows, where, slice_rows=400)
    return where


def keys(found):
    return [(r.product_id, r.version, r.bug_id, r.page_ordinal, r.row_ordinal) for r in found]


def test_pages_are_those_of_the_whole_order(spark, rows, path):
    whole = keys(cards.placed(rows).orderBy(*cards.ORDER).collect())
    last = -(-len(whole) // 50)
    for page in (1, 2, 8, 9, 40, last, last + 7):
        at = (min(page, last) - 1) * 50
        found = catalog.open_page(spark, path, page).collect()
        assert keys(found) == whole[at : at + 50]
        assert [r.position for r in found] == list(range(at, at + len(found)))


def test_a_page_opens_few_slices_and_sorts_no_more_than_the_page(spark, path):
    page = catalog.open_page(spark, path, 60)
    assert len({f.rsplit("/slice=")[1].split("/")[0] for f in page.inputFiles()}) >= 1
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(slice" in plan or "PartitionFilters: [slice" in plan
    assert "TakeOrdered" not in plan


@pytest.mark.parametrize("term", ["Size 7", "zzz", "load set", "si", "", "7 ISS-1"])
def test_search_gives_the_rows_of_a_scan(spark, rows, path, term):
    found = catalog.search_catalog(spark, path, term, issue_type="known")
    assert sorted(keys(found.collect())) == sorted(keys(search.search(rows, term, issue_type="known").collect()))


def test_slices_without_the_triples_are_not_opened(spark, rows, path):
    one = rows.where("issue_type = 'known'").first().bug_id.lower()
    slices = catalog.candidate_slices(spark, path, one).count()
    assert 0 < slices < spark.read.parquet(f"{path}/slices").count()
    assert catalog.candidate_slices(spark, path, "si") is None
    plan = catalog.search_catalog(spark, path, one)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan


def test_an_empty_catalog(spark, rows, tmp_path):
    where = str(tmp_path / "c")
    catalog.write_catalog(rows.limit(0), where)
    assert catalog.open_page(spark, where, 3).count() == 0
    assert catalog.search_catalog(spark, where, "anything").count() == 0


def test_small_slices_share_a_partition(spark, rows, path):
    """At most the wanted rows in a slice, in far fewer files of triples and sorted partitions than slices."""
    slices = spark.read.parquet(f"{path}/slices").orderBy("slice").collect()
    assert sum(s.n for s in slices) == rows.count() and max(s.n for s in slices) <= 400
    assert len({s.slice >> catalog._CUTS for s in slices}) == 1 < len(slices)
    assert [s.first for s in slices] == [sum(t.n for t in slices[:i]) for i in range(len(slices))]
    assert len(spark.read.parquet(f"{path}/triples").inputFiles()) == 1
