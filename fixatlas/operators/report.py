"""Counts over a data set and over one load."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fixatlas import fixed


def _kind(name: str) -> Column:
    return F.count_if(F.col("issue_type") == name)


def version_matrix(issues: DataFrame) -> DataFrame:
    """Known and addressed rows of every version; a side without rows counts 0.

    On flat rows the outer join of both sides is one aggregation.
    """
    return issues.groupBy("product_id", "version").agg(
        _kind("known").alias("known"), _kind("addressed").alias("addressed")
    )


def dataset_stats(issues: DataFrame) -> DataFrame:
    """Products, versions and issues; distinct counts run on the small version matrix."""
    return version_matrix(issues).agg(
        F.count_distinct("product_id").alias("products"),
        F.count("*").alias("versions"),
        F.coalesce(F.sum("known"), F.lit(0)).alias("known"),
        F.coalesce(F.sum("addressed"), F.lit(0)).alias("addressed"),
    )


def fetch_report(issues: DataFrame, fetch_log: DataFrame, products: DataFrame) -> DataFrame:
    """One row per product of this load and a total (``product_id`` null).

    ``products`` are all that the load was to fetch: one of which every page failed has a
    row too. ``issues`` are the rows of this load only, not of the merged data set. Failures
    count for the total whatever product they name, also one that is in no list.
    """
    none = F.lit(None).cast("string")
    zero = F.lit(0).cast("bigint")
    counts = ["versions", "known", "addressed", "failed"]
    # One row for each version, for the failures of each product and for each product asked for.
    rows = (
        version_matrix(issues).select("product_id", "version", F.lit(1).cast("bigint").alias("versions"), "known", "addressed", zero.alias("failed"))
        .unionByName(
            fetch_log.filter("error is not null").groupBy("product_id").agg(F.count("*").alias("failed"))
            .select("product_id", none.alias("version"), *[zero.alias(c) for c in counts[:3]], "failed")
        )
        .unionByName(products.select("product_id", none.alias("version"), *[zero.alias(c) for c in counts]))
    )
    per_product = rows.groupBy("product_id").agg(
        *[F.sum(c).alias(c) for c in counts], F.array_sort(F.collect_list("version")).alias("version_list")
    )
    # The total gathers no lists: only the rows of products carry theirs.
    whole = F.grouping("product_id") == 1
    return per_product.rollup("product_id").agg(
        *[F.sum(c).alias(c) for c in counts], F.first("version_list").alias("version_list"), whole.alias("_whole")
    ).select("product_id", *counts, F.when(~F.col("_whole"), F.col("version_list")).alias("version_list"))


def first_n(rows: DataFrame, keys: list[str], item: str, n: int, order: list | None = None):
    """First ``n`` items of each key in order, with how many more there are.

    Only the first ``n`` rows of a key are ever gathered; the rest is a count.
    """
    order = [F.col(item)] if order is None else order
    window = Window.partitionBy(*keys).orderBy(*order)
    first = (
        rows.select(*keys, item, F.row_number().over(window).alias("_n"))
        .filter(F.col("_n") <= n)
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("_n", item))).alias("_items"))
    )
    totals = rows.groupBy(*keys).agg(F.count("*").alias("_total"))
    return first.join(totals, keys).select(
        *keys,
        F.col(f"_items.{item}").alias("items"),
        F.greatest(F.col("_total") - n, F.lit(0)).alias("more"),
    )


def sample_ids(issues: DataFrame, n: int = fixed.SAMPLE_IDS_SHOWN) -> DataFrame:
    """First identifiers of each product and version in the order of the issues, and how many more."""
    ids = issues.groupBy("product_id", "version", "bug_id").agg(F.min(F.struct("page_ordinal", "row_ordinal")).alias("place"))
    return first_n(ids, ["product_id", "version"], "bug_id", n, [F.col("place"), F.col("bug_id")])


def sample_versions(placed: DataFrame, n: int = fixed.VERSIONS_SHOWN) -> DataFrame:
    """Newest versions per product out of `search.versions_newest_first`."""
    return first_n(placed, ["product_id"], "version", n, [F.col("place")])
