"""One result page as it is shown: search, slice, then the release joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fixatlas.functions import text as tx
from fixatlas.operators import releases, search


# The digest tells different rows apart that stand at one place; ``numbered`` does so for equal rows.
ORDER = ["product_ordinal", "version_ordinal", "kind_rank", "page_ordinal", "row_ordinal", "row_digest"]
KEYSET = [*ORDER, "row_copy"]


def placed(issues: DataFrame) -> DataFrame:
    """Issues with what puts them in document order, all ascending and never null.

    Products stand in the order of their ids, a product's versions newest first, known before
    addressed, then pages and rows as they came. Only versions are ordered, not issues. All this is
    worked out row by row, so a search filters first.
    """
    versions = search.versions_newest_first(issues).withColumnRenamed("place", "version_ordinal")
    products = versions.select("product_id").distinct()
    numbered = products.select(
        "product_id", F.row_number().over(Window.orderBy("product_id")).cast("bigint").alias("product_ordinal")
    )  # one row per product, a few dozen
    order = versions.join(numbered, "product_id")
    rank = F.when(F.col("issue_type") == "known", 0).otherwise(1)
    # Nulls are kept apart from empty texts: a field that is null is not written.
    digest = F.sha2(F.to_json(F.struct(*issues.columns)), 256)
    return issues.withColumn("row_digest", digest).join(order, ["product_id", "version"]).withColumns(
        {
            "kind_rank": rank,
            "page_ordinal": F.coalesce("page_ordinal", F.lit(-1)),
            "row_ordinal": F.coalesce("row_ordinal", F.lit(-1)),
        }
    )


def shown_at_all(issues: DataFrame) -> DataFrame:
    """The issues that have a place, to be counted without working it out."""
    return issues.dropna(subset=["product_id", "version"])


def numbered(found: DataFrame) -> DataFrame:
    """Placed rows with the number of their copy, so that no two are alike in ``KEYSET``.

    Only what a search has left is dealt by digest.
    """
    copies = Window.partitionBy("row_digest").orderBy("row_digest")
    return found.withColumn("row_copy", F.row_number().over(copies))


def result_page(issues: DataFrame, page: int = 1, size: int = 50, **facets) -> DataFrame:
    """Cards of one page: label, whether to show the fix text, fix and sibling releases.

    The joins see only the rows of the page, not the whole result.
    """
    found, counted = (search.search(rows, **facets) for rows in (placed(issues), shown_at_all(issues)))
    shown = search.page_slice(found, ORDER, page, size, counted=counted)
    cards = releases.also_affected(releases.with_fixes(shown, issues), issues)
    known = F.col("issue_type") == "known"
    return cards.withColumns(
        {
            "label": tx.display_label(F.col("product_name"), F.col("version")),
            "show_fix_info": tx.show_fix_info(F.col("fix_info")),
            "fix_available": known & F.col("fix_available"),
            "others_known": known & (F.col("n_others") > 0),
        }
    )
