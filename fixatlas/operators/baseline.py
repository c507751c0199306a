"""Snapshots of a data set and what went missing between two of them.

A snapshot is two tables: counts per version, and distinct identifiers per
version in long form.  Identifiers stay rows, so a version of any size is
compared by joins and never becomes one array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fixatlas import fixed
from fixatlas.operators.report import first_n

VERSION = ["product_id", "version"]
DIGEST = ["n_ids", "bits_1", "bits_2"]


def _named(issues: DataFrame) -> DataFrame:
    return issues.filter("product_id <> '' and version <> ''")


def _digest() -> list[Column]:
    named = F.when(F.col("bug_id") != "", F.col("bug_id"))
    hashes = [F.xxhash64(named), F.xxhash64(F.lit(1), named)]
    return [F.bit_xor(F.when(named.isNotNull(), h)).alias(c) for h, c in zip(hashes, DIGEST[1:])]


def fingerprint(issues: DataFrame, digest: bool = False) -> DataFrame:
    """Rows of both kinds and the number of distinct identifiers of every version.

    With ``digest`` also 128 bits that stand for the identifiers, from the same pass (see `digests`).
    """
    by_id = (
        _named(issues)
        .groupBy(*VERSION, "bug_id")
        .agg(
            F.count_if(F.col("issue_type") == "known").alias("known"),
            F.count_if(F.col("issue_type") == "addressed").alias("addressed"),
        )
    )
    return by_id.groupBy(*VERSION).agg(
        F.sum("known").alias("known"),
        F.sum("addressed").alias("addressed"),
        F.count_if(F.col("bug_id") != "").alias("n_bug_ids"),
        *(_digest() if digest else []),
    )


def bug_ids(issues: DataFrame) -> DataFrame:
    """Distinct identifiers of every version, whichever side lists them."""
    return _named(issues).filter("bug_id <> ''").select(*VERSION, "bug_id").distinct()


def digests(ids: DataFrame) -> DataFrame:
    """One small row for the distinct identifiers of a version: their number and 128 bits, whatever their order.

    The bits are exclusive sums of two hashes of each identifier, so digests of parts of a version
    that share no identifier are merged by adding the numbers and the exclusive sum of the bits
    (see `merged_digests`). Versions without identifiers have none.
    """
    return ids.filter("bug_id <> ''").groupBy(*VERSION).agg(F.count("*").alias("n_ids"), *_digest())


def merged_digests(parts: DataFrame) -> DataFrame:
    """Digests of whole versions from those of parts without common identifiers."""
    return parts.groupBy(*VERSION).agg(
        F.sum("n_ids").alias("n_ids"), F.bit_xor("bits_1").alias("bits_1"), F.bit_xor("bits_2").alias("bits_2")
    )


def changed_versions(before_digests: DataFrame, after_digests: DataFrame) -> DataFrame:
    """Versions of both snapshots whose identifiers are not the same."""
    after = after_digests.select(*VERSION, *[F.col(c).alias(f"_{c}") for c in DIGEST])
    same = [F.col(c) == F.col(f"_{c}") for c in DIGEST]
    return before_digests.join(after, VERSION).filter(~(same[0] & same[1] & same[2])).select(*VERSION)


def ids_by_kind(issues: DataFrame) -> DataFrame:
    return issues.select(*VERSION, "issue_type", "bug_id").distinct()


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """Both counts of every version of either snapshot; nulls where it is absent."""
    def side(df, name):
        return df.select(
            *VERSION,
            F.col("known").alias(f"{name}_known"),
            F.col("addressed").alias(f"{name}_addressed"),
        )

    return side(before, "before").join(side(after, "after"), VERSION, "full_outer")


def _delta(kind, when, version=None, issue_type=None, before=None, after=None) -> Column:
    """One delta as a struct, null unless ``when``."""

    def value(x, dtype):
        return (F.lit(None) if x is None else x).cast(dtype)

    return F.when(
        when,
        F.struct(
            F.lit(kind).alias("delta_kind"),
            value(version, "string").alias("version"),
            value(issue_type, "string").alias("issue_type"),
            value(before, "bigint").alias("before_n"),
            value(after, "bigint").alias("after_n"),
        ),
    )


def _losses() -> list[Column]:
    """Sides of a compared version that lost rows."""
    version = F.col("version")
    return [
        _delta(
            "count_regression", F.col(f"after_{k}") < F.col(f"before_{k}"), version, F.lit(k),
            F.col(f"before_{k}"), F.col(f"after_{k}"),
        )
        for k in ("known", "addressed")
    ]


def _exploded(rows: DataFrame, deltas: list[Column]) -> DataFrame:
    return rows.select("product_id", F.explode(F.array_compact(F.array(*deltas))).alias("_d")).select(
        "_d.delta_kind", "product_id", "_d.version", "_d.issue_type", "_d.before_n", "_d.after_n"
    )


def count_regressions(compared: DataFrame) -> DataFrame:
    """Versions of both snapshots that lost rows on a side."""
    return _exploded(compared, _losses())


def missing_ids(before_ids: DataFrame, after_ids: DataFrame, changed: DataFrame | None = None) -> DataFrame:
    """Identifiers gone from versions that still exist.

    With ``changed`` (see `changed_versions`) only identifiers of those versions are compared. They are
    taken out of both snapshots before anything meets: the list of versions goes to the
    scans if Spark finds it small, and rows of other versions are not shuffled.
    """
    if changed is None:
        still = after_ids.select(*VERSION).distinct()
        return before_ids.join(after_ids, [*VERSION, "bug_id"], "left_anti").join(
            still, VERSION, "left_semi"
        )
    before_ids, after_ids = (ids.join(changed, VERSION, "left_semi") for ids in (before_ids, after_ids))
    # A changed version is one of both snapshots, so it still exists.
    return before_ids.join(after_ids, [*VERSION, "bug_id"], "left_anti")


def diff(
    before: DataFrame, after: DataFrame, before_ids: DataFrame, after_ids: DataFrame,
    before_digests: DataFrame | None = None, after_digests: DataFrame | None = None,
) -> DataFrame:
    """All deltas between two snapshots in long form.

    Versions are only reported for products of both snapshots: a product that is gone
    is one delta, not one per version.  Missing identifiers are a row each (``missing_id``)
    and a count for their version (``missing_ids``); nothing is shortened.  The counts are
    joined once; a product's versions, not its issues, are looked at together. With the digests
    of both snapshots identifiers of unchanged versions are left aside.
    """
    pruned = before_digests is not None and after_digests is not None
    changed = changed_versions(before_digests, after_digests) if pruned else None
    product = Window.partitionBy("product_id")
    old, new = F.col("before_known").isNotNull(), F.col("after_known").isNotNull()
    compared = compare(before, after).withColumns(
        {
            "had": F.bool_or(old).over(product),
            "has": F.bool_or(new).over(product),
            "first": F.row_number().over(product.orderBy("version")) == 1,
        }
    )
    both = F.col("had") & F.col("has")
    counts = _exploded(
        compared,
        [
            _delta("product_added", F.col("first") & ~F.col("had")),
            _delta("product_removed", F.col("first") & ~F.col("has")),
            _delta("version_added", both & ~old, F.col("version")),
            _delta("version_removed", both & ~new, F.col("version")),
            *_losses(),
        ],
    ).withColumn("bug_id", F.lit(None).cast("string"))
    gone = missing_ids(before_ids, after_ids, changed).rollup("product_id", "version", "bug_id").agg(
        F.count("*").alias("n")
    )
    # Rolled up once: rows of a version and, under it, of each identifier.
    ids = gone.where("version is not null").select(
        F.when(F.col("bug_id").isNull(), "missing_ids").otherwise("missing_id").alias("delta_kind"),
        "product_id", "version", F.lit(None).cast("string").alias("issue_type"),
        F.when(F.col("bug_id").isNull(), F.col("n")).alias("before_n"),
        F.lit(None).cast("bigint").alias("after_n"), "bug_id",
    )
    return counts.unionByName(ids)


def missing_id_samples(deltas: DataFrame, n: int = fixed.MISSING_IDS_SHOWN) -> DataFrame:
    """For display: the first ``n`` missing identifiers of each version, and how many more."""
    return first_n(deltas.where("delta_kind = 'missing_id'"), VERSION, "bug_id", n)


def verdict(deltas: DataFrame) -> DataFrame:
    """One row: clean unless something was lost.  Additions are never dirty."""
    # Single identifiers are counted with their version.
    lost = ~F.col("delta_kind").isin("product_added", "version_added", "missing_id")
    return deltas.agg(
        (F.count_if(lost) == 0).alias("is_clean"), F.count_if(lost).alias("n_losses")
    )


def parity(before: DataFrame, after: DataFrame, min_ratio: float = 1.0) -> DataFrame:
    """Versions of the old snapshot whose new count fell under ``min_ratio`` of the old.

    A version that is gone counts 0; a side that was empty cannot regress.
    """
    def value(name, kind) -> Column:
        return F.coalesce(F.col(f"{name}_{kind}"), F.lit(0))

    sides = F.array(
        *[
            F.struct(
                F.lit(k).alias("issue_type"),
                value("before", k).alias("before_n"),
                value("after", k).alias("after_n"),
            )
            for k in ("known", "addressed")
        ]
    )
    old_keys = compare(before, after).filter("before_known is not null")
    return (
        old_keys.select(*VERSION, F.explode(sides).alias("_s"))
        .select(*VERSION, "_s.*")
        .filter((F.col("before_n") > 0) & (F.col("after_n") < F.col("before_n") * min_ratio))
    )


def parity_keys(before: DataFrame, after: DataFrame) -> DataFrame:
    """Versions only one of two snapshots has."""
    compared = compare(before, after)
    return compared.select(
        *VERSION,
        F.when(F.col("before_known").isNull(), "only_new")
        .when(F.col("after_known").isNull(), "only_old")
        .alias("side"),
    ).filter("side is not null")
