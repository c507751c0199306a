"""Sortable keys for version strings.

Every key is an ordinary Spark array or struct, so it works in ORDER BY,
``max_by``, windows and range partitioning without a comparator.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fixatlas import fixed


def _number(text: Column) -> Column:
    return F.coalesce(text.try_cast("bigint"), F.lit(0).cast("bigint"))


def _groups(version: Column, pattern: str, n: int) -> list[Column]:
    return [_number(F.regexp_extract(version, pattern, i)) for i in range(1, n + 1)]


def key_patch(version: Column) -> Column:
    """``[major, minor, patch, digits of the suffix]``; zeros unless three-part.

    Only the start is anchored, and letters of the suffix do not count.
    """
    pattern = r"^(\d+)\.(\d+)\.(\d+)(?:-(.+))?"
    suffix = F.regexp_extract(version, pattern, 4)
    return F.array(*_groups(version, pattern, 3), _number(F.regexp_extract(suffix, r"(\d+)", 1)))


def key_calendar(version: Column) -> Column:
    """``[year, release, patch]`` of ``2025.r5.0``, zeros otherwise."""
    return F.array(*_groups(version, r"^(\d{4})\.r(\d+)\.(\d+)", 3))


def key_edition(version: Column) -> Column:
    """``[major, minor, is CE]`` of ``8.3-CE``, zeros otherwise."""
    pattern = r"^(\d+)\.(\d+)"
    ce = version.rlike(pattern) & F.upper(version).contains("CE")
    return F.array(*_groups(version, pattern, 2), F.when(ce, 1).otherwise(0).cast("bigint"))


def key_major(slug: Column) -> Column:
    """Numbers of a dashed major such as ``11-2``."""
    return F.transform(F.split(slug, "-"), _number)


def _segments(base: Column, keep_empty: bool) -> Column:
    parts = F.split(base, r"\.")
    if not keep_empty:
        parts = F.filter(parts, lambda p: p != "")
    segments = F.transform(
        parts,
        lambda p: F.struct(
            _number(F.regexp_extract(p, r"^(\d+)", 1)).alias("num"),
            F.regexp_replace(p, r"^\d+", "").alias("rest"),
        ),
    )
    # A missing segment counts as (0, ''), the least one there is.  Dropping those at
    # the end makes "shorter prefix first", Spark's array order, say the same thing.
    last = F.array_max(
        F.transform(
            segments,
            lambda s, i: F.when((s["num"] != 0) | (s["rest"] != ""), i + 1).otherwise(0),
        )
    )
    return F.slice(segments, F.lit(1), F.coalesce(last, F.lit(0)))


def key_segments(version: Column) -> Column:
    """Dot segments only, no special versions: order of a product's version list."""
    return _segments(version, keep_empty=True)


def key_full(version: Column) -> Column:
    """Order across all schemes: Unknown < numbered (hotfix last) < SaaS."""
    hotfix = r"(?i)^(.+?)-h(\d+)$"
    base = F.coalesce(F.nullif(F.regexp_extract(version, hotfix, 1), F.lit("")), version)
    special = version.isin(fixed.HIDDEN_VERSIONS)
    dotted = F.when(special, "").otherwise(F.regexp_replace(base, "(?i)r", "."))
    return F.struct(
        F.when(version == fixed.VERSION_SAAS, 2)
        .when(version == fixed.VERSION_UNKNOWN, 0)
        .otherwise(1)
        .alias("rank"),
        _segments(dotted, keep_empty=False).alias("segments"),
        _number(F.regexp_extract(version, hotfix, 2)).alias("hotfix"),
    )


def major_of(version: Column) -> Column:
    """``26.2.1`` to ``26-2``; null for a version of one part."""
    parts = F.split(version, r"\.")
    return F.when(F.size(parts) >= 2, F.concat_ws("-", F.slice(parts, 1, 2)))
