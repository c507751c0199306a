"""First-wins deduplication of issues."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCOPE = ("product_id", "version", "issue_type")
ORDER = ("page_ordinal", "row_ordinal")


def dedup_issues(issues: DataFrame, scope=SCOPE, order=ORDER) -> DataFrame:
    """First row of each (scope, bug id, release date, text).

    Texts are compared whole, behind a short hash that settles almost every comparison.  Spark turns ``row_number() = 1`` into a group limit before the shuffle,
    so many copies of one issue are reduced to one per task where they are read.
    """
    # Without nulls the text is a column that can be compared as it is, not a second one that travels along.
    rows = issues.withColumns(
        {"_none": F.col("description").isNull(), "description": F.coalesce("description", F.lit(""))}
    ).withColumn("_short", F.xxhash64("description"))
    key = Window.partitionBy(*scope, "bug_id", "release_date", "_short", "description").orderBy(*order)
    first = rows.withColumn("_n", F.row_number().over(key)).filter("_n = 1")
    return first.withColumn("description", F.expr("if(_none, null, description)")).select(*issues.columns)
