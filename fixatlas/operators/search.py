"""Search, facets and paging over flat issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fixatlas import fixed
from fixatlas.functions import versions as vx
from fixatlas.functions.text import blank_to_null


def search_text(df: DataFrame) -> Column:
    """Lower-cased text a term is looked up in; worth storing as a column of the table.

    Fields are joined by a space, so a term may run from one field into the next.
    """
    return F.lower(
        F.concat_ws(
            " ",
            *[blank_to_null(F.col(c)) for c in ("bug_id", "description", "symptoms", "workaround")],
            F.filter("affected_components", lambda c: c != ""),
        )
    )


def search(
    issues: DataFrame,
    term: str = "",
    product: str = "",
    version: str = "",
    issue_type: str = "",
) -> DataFrame:
    """Rows that contain the term and match every facet; an empty argument is no filter.

    The equalities come first: they reach the scan, the substring test cannot.
    """
    out = issues
    for column, value in (("product_id", product), ("version", version), ("issue_type", issue_type)):
        if value:
            out = out.filter(F.col(column) == value)
    if term:
        text = F.col("search_text") if "search_text" in issues.columns else search_text(issues)
        out = out.filter(text.contains(term.lower()))
    return out


def suggest(options: DataFrame, typed: str, label: str = "product_name") -> DataFrame:
    """Distinct options whose label contains what was typed."""
    return options.filter(F.lower(label).contains(typed.lower())).distinct()


def component_counts(issues: DataFrame) -> DataFrame:
    return (
        issues.select("product_id", F.explode("affected_components").alias("component"))
        .groupBy("product_id", "component")
        .agg(F.count("*").alias("n_issues"))
    )


def page_count(total: Column, size: int | None = fixed.PAGE_SIZE) -> Column:
    """Pages of a result; ``None`` shows all rows on one page."""
    if size is None:
        return F.lit(1).cast("bigint")
    return F.ceil(total / F.lit(size)).cast("bigint")


def page_slice(
    rows: DataFrame, order: list, page: int, size: int | None = fixed.PAGE_SIZE, counted: DataFrame | None = None
):
    """Rows of one page in the given order; a page past the end is the last page.

    Pages after the first count first, because only the count knows the last page; ``counted`` has
    as many rows, without what only orders them, where that is cheaper to count.  Planned as a top-k of
    ``offset + size`` rows, so it suits the pages people look at; to walk a whole
    result use `page_after`, and for any page of a stored set `plans.catalog.open_page`.
    """
    ordered = rows.orderBy(*order)
    if size is None:
        return ordered
    if page <= 1:
        return ordered.limit(size)
    pages = -(-(rows if counted is None else counted).count() // size)
    return ordered.offset(max(min(page, pages) - 1, 0) * size).limit(size)


def page_after(rows: DataFrame, order: list[str], last: list | None, size: int = fixed.PAGE_SIZE):
    """Next rows after a known last key: same cost for the first page and the millionth.

    All columns of ``order`` are ascending and have no nulls, and no two rows are equal in all of
    them, as `plans.cards.numbered` makes them.
    """
    if last is not None:
        rows = rows.filter(
            F.struct(*order) > F.struct(*[F.lit(v).alias(c) for c, v in zip(order, last)])
        )
    return rows.orderBy(*order).limit(size)


def page_strip(current: Column, total: Column) -> Column:
    """Page numbers to show: all up to 7, else both ends, the neighbours and dots."""
    def text(c):
        return c.cast("string")

    one, none = F.lit(1), F.array().cast("array<string>")
    dots = F.array(F.lit("..."))
    around = F.sequence(F.greatest(F.lit(2), current - 1), F.greatest(F.least(total - 1, current + 1), F.lit(2)))
    middle = F.transform(
        F.filter(around, lambda x: (x > 1) & (x < total) & (x <= current + 1) & (x >= current - 1)),
        text,
    )
    short = F.transform(F.sequence(one.cast("bigint"), F.greatest(total, one)), text)
    return F.when(total < 1, none).when(total <= 7, short).otherwise(
        F.concat(
            F.array(F.lit("1")),
            F.when(current > 3, dots).otherwise(none),
            middle,
            F.when(current < total - 2, dots).otherwise(none),
            F.array(text(total)),
        )
    )


def versions_newest_first(issues: DataFrame, key=vx.key_full, ordinal: str = "page_ordinal"):
    """Distinct versions of a product with their rank; ties keep the order of appearance.

    Issues shrink to one row per version before anything is sorted.
    """
    seen = issues.groupBy("product_id", "version").agg(F.min(ordinal).alias("first_seen"))
    order = Window.partitionBy("product_id").orderBy(
        key(F.col("version")).desc(), F.col("first_seen"), F.col("version")
    )
    return seen.select(
        "product_id", "version", F.row_number().over(order).cast("bigint").alias("place")
    )


def product_versions(issues: DataFrame) -> DataFrame:
    """Versions offered in a product's list: hidden ones left out, dot segments only."""
    shown = issues.filter(~F.col("version").isin(fixed.HIDDEN_VERSIONS))
    return versions_newest_first(shown, key=vx.key_segments)
