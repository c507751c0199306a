"""A few registered queries against their SQL; `tools/check.py` runs all of them."""

import pytest

import __spark_entry__ as entry
from fixatlas.workloads import EXPECTED, QUERIES
from check import compare, connect

DATA = "/root/testdata/sf0.001"
SAMPLE = ["also_affected", "dedup_issues", "merge_databases", "parity_check", "extract_dispatch", "version_pages"]


def test_entry_and_registry(spark):
    assert entry.entry(spark).columns[:2] == ["product_id", "bug_id"]
    assert set(EXPECTED) == set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_query_agrees_with_its_sql(spark, name):
    message, _, good = compare(
        spark, connect(DATA), name, entry.queries()[name], entry.oracle_sql()[name], DATA
    )
    assert good, message


@pytest.mark.parametrize("name", ["fix_available", "also_affected", "baseline_diff", "drop_index_pages"])
def test_no_nested_loop_or_cartesian_join(spark, name):
    plan = entry.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
