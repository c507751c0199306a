"""Bringing increments into a held data set."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fixatlas.operators.dedup import dedup_issues

VERSION_KEY = ["product_id", "version"]


def existing_versions(issues: DataFrame) -> DataFrame:
    return issues.select(*VERSION_KEY).distinct()


def merge_issues(existing: DataFrame, new: DataFrame, replace_changed: bool = False) -> DataFrame:
    """Existing versions win; versions not held are added whole.

    With ``replace_changed`` the new side wins instead, so that a page that changed
    inside a held version is not lost.  The product name always comes from the
    existing side when it has the product.  Only distinct (product, version) keys
    meet the rows, however many rows a version has.
    """
    names = existing.groupBy("product_id").agg(F.min_by("product_name", "version").alias("_name"))
    if replace_changed:
        kept = existing.join(existing_versions(new), VERSION_KEY, "left_anti")
        added = new
    else:
        kept = existing
        added = new.join(existing_versions(existing), VERSION_KEY, "left_anti")
    added = (
        added.join(names, "product_id", "left")
        .withColumn("product_name", F.coalesce("_name", "product_name"))
        .drop("_name")
    )
    return kept.unionByName(added)


def merge_index_issues(issues: DataFrame, index_issues: DataFrame) -> DataFrame:
    """Adds issues of an all-versions index page behind those of the version's own pages.

    Versions only the index page knows appear by themselves; duplicates fall to the
    row that stands first, the version page's.
    """
    both = issues.withColumn("_late", F.lit(0)).unionByName(
        index_issues.withColumn("_late", F.lit(1))
    )
    return dedup_issues(both, order=("_late", "page_ordinal", "row_ordinal")).drop("_late")


def merge_metadata(existing: DataFrame, generated_at) -> DataFrame:
    """Keeps version and source of the held data set, refreshes its timestamp."""
    return existing.withColumn("generated_at", generated_at)


def upsert_manifest(manifest: DataFrame, seen: DataFrame) -> DataFrame:
    """Latest record per (product, url); ``seq`` tells later from earlier.

    ``seen`` must hold pages that were read, not all that were planned: a page that
    failed stays due for the next run.
    """
    latest = Window.partitionBy("product_id", "url").orderBy(F.col("seq").desc())
    return (
        manifest.unionByName(seen)
        .withColumn("_n", F.row_number().over(latest))
        .filter("_n = 1")
        .drop("_n")
    )
