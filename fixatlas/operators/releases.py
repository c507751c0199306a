"""Joins across releases: where an issue is fixed, where else it is known.

A bug can be known in a great many rows, so rows are never paired with rows.
Releases are first reduced to one row per (product, bug, version), which bounds
a group by the number of versions of a product, and only then meet the issues.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fixatlas.functions import versions as vx

BUG = ["product_id", "bug_id"]


def releases(issues: DataFrame, issue_type: str) -> DataFrame:
    """Releases naming a bug, newest first: ``n`` rows each, ``place`` in the bug's list."""
    counted = (
        issues.filter(F.col("issue_type") == issue_type)
        .groupBy(*BUG, "version")
        .agg(F.count("*").alias("n"))
    )
    newest = Window.partitionBy(*BUG).orderBy(
        vx.key_full(F.col("version")).desc(), F.col("version").desc()
    )
    return counted.withColumn("place", F.row_number().over(newest).cast("bigint"))


def fix_releases(issues: DataFrame) -> DataFrame:
    return releases(issues, "addressed")


def known_releases(issues: DataFrame) -> DataFrame:
    return releases(issues, "known")


def fix_summary(issues: DataFrame) -> DataFrame:
    """One row per (product, bug): how many fixes are listed, and the newest."""
    version = F.col("version")
    per_version = (
        issues.filter("issue_type = 'addressed'")
        .groupBy(*BUG, "version")
        .agg(F.count("*").alias("n"))
    )
    return per_version.groupBy(*BUG).agg(
        F.sum("n").alias("n_fixes"),
        F.max(F.struct(vx.key_full(version).alias("key"), version.alias("version")))[
            "version"
        ].alias("newest_fix"),
    )


def with_fixes(known: DataFrame, issues: DataFrame) -> DataFrame:
    """Known issues with ``fix_available``, ``n_fixes`` and ``newest_fix`` of the same product."""
    joined = known.join(fix_summary(issues), BUG, "left")
    return joined.withColumns(
        {
            "n_fixes": F.coalesce("n_fixes", F.lit(0)),
            "fix_available": F.coalesce(F.col("n_fixes") > 0, F.lit(False)),
        }
    )


def other_releases(issues: DataFrame) -> DataFrame:
    """Per (product, bug, version): known rows in other versions and the newest of those."""
    # The sort key is a column: as an expression it would differ in each window, and each would sort and hold all rows.
    counted = (
        issues.filter("issue_type = 'known'")
        .groupBy(*BUG, "version")
        .agg(F.count("*").alias("n"))
        .withColumn("_key", vx.key_full(F.col("version")))
    )
    order = Window.partitionBy(*BUG).orderBy(F.col("_key").desc(), F.col("version").desc())
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.first("version").over(whole)
    return counted.select(
        *BUG,
        "version",
        (F.sum("n").over(whole) - F.col("n")).alias("n_others"),
        F.when(first != F.col("version"), first)
        .otherwise(F.nth_value("version", 2).over(whole))
        .alias("newest_other"),
    )


def also_affected(known: DataFrame, issues: DataFrame) -> DataFrame:
    """Known issues with the number of other known listings of the same bug and product."""
    return known.join(other_releases(issues), [*BUG, "version"], "left").withColumn(
        "n_others", F.coalesce("n_others", F.lit(0))
    )


def release_list(asked: DataFrame, listed: DataFrame, other_than_own: bool = False) -> DataFrame:
    """Release list behind a few chosen issues (the rows on screen), newest first.

    ``asked`` has product, bug and version; pass the result of `fix_releases` or
    `known_releases` as ``listed``.
    """
    a, r = asked.select(*BUG, "version").alias("a"), listed.alias("r")
    on = [F.col(f"a.{k}") == F.col(f"r.{k}") for k in BUG]
    if other_than_own:
        on.append(F.col("a.version") != F.col("r.version"))
    return a.join(r, on).select(
        "a.product_id", "a.bug_id", "a.version", F.col("r.version").alias("listed_version"),
        "r.n", "r.place",
    )
