"""JSON documents: the nested tracker, release logs, load reports, cached work lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fixatlas import fixed

ISSUE = (
    "bug_id:string,description:string,symptoms:string,workaround:string,fix_info:string,"
    "affected_components:array<string>,release_date:string"
)
VERSION = (
    f"version:string,part:bigint,release_date:string,known_issues:array<struct<{ISSUE}>>,"
    f"addressed_issues:array<struct<{ISSUE}>>"
)
PRODUCT_SCHEMA = f"id string, name string, versions array<struct<{VERSION}>>"
RELEASE_SCHEMA = (
    "version string, date string, title string, "
    "changes array<struct<type:string,description:string>>"
)
REPORT_SCHEMA = (
    "generated_at string, data_file string, total_products bigint, total_versions bigint, "
    "total_known_issues bigint, total_addressed_issues bigint, "
    "product_stats array<struct<product_id:string,product_name:string,versions_fetched:bigint,"
    "versions:array<string>,known_issues_count:bigint,addressed_issues_count:bigint,"
    "failed_fetch_count:bigint>>, "
    "failed_fetches array<struct<url:string,error:string,product:string,version:string,"
    "issue_type:string>>"
)
CACHE_SCHEMA = (
    "schema_version int, product_id string, updated_at string, major string, version string, "
    "known_issues_urls array<string>, addressed_issues_urls array<string>"
)

_ISSUE_FIELDS = [f.split(":")[0] for f in ISSUE.split(",")]


def nest_versions(issues: DataFrame, pages_per_part: int = 1000) -> DataFrame:
    """Flat issues to tracker entries, one row per (product, version, part).

    A version is cut into parts by source page, so the lists of one entry are bounded
    by ``pages_per_part`` pages however large the version is; the entries carry the
    part's number, by which a reader puts them in order again.
    """
    issue = F.struct("page_ordinal", "row_ordinal", F.struct(*_ISSUE_FIELDS).alias("issue"))

    def side(kind):
        rows = F.array_sort(F.collect_list(F.when(F.col("issue_type") == kind, issue)))
        return F.transform(rows, lambda r: r["issue"])

    part = F.floor(F.col("page_ordinal") / pages_per_part)
    date = "version_release_date"
    dates = [F.max(date).alias(date)] if date in issues.columns else []
    return issues.groupBy("product_id", "product_name", "version", part.alias("part")).agg(
        side("known").alias("known_issues"), side("addressed").alias("addressed_issues"), *dates
    )


def to_documents(nested: DataFrame) -> DataFrame:
    """Tracker entries in the document shape: product with a list of versions.

    A version keeps its date if the issues have a column ``version_release_date``.
    """
    date = F.col("version_release_date") if "version_release_date" in nested.columns else F.lit(None).cast("string")
    version = F.struct(
        "version",
        "part",
        date.alias("release_date"),
        "known_issues",
        "addressed_issues",
    )
    return nested.select(
        F.col("product_id").alias("id"),
        F.col("product_name").alias("name"),
        F.array(version).alias("versions"),
    )


def write_tracker(issues: DataFrame, path: str, pages_per_part: int = 1000) -> None:
    """JSON lines, nulls left out; gzipped, since the same names and texts stand in every line."""
    documents = to_documents(nest_versions(issues, pages_per_part))
    documents.write.mode("overwrite").options(ignoreNullFields="true", compression="gzip").json(path)


METADATA_SCHEMA = "generated_at string, version string, source string"


def write_metadata(metadata: DataFrame, path: str) -> None:
    """Metadata of a tracker (see ``METADATA_SCHEMA``) as JSON lines beside its products."""
    metadata.write.mode("overwrite").json(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METADATA_SCHEMA).json(path)


def read_tracker(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    return spark.read.schema(PRODUCT_SCHEMA).option("multiLine", multiline).json(path)


def read_tracker_file(spark: SparkSession, path: str) -> DataFrame:
    """Products of whole-file documents ``{metadata, products: [...]}``."""
    schema = f"products array<struct<id:string,name:string,versions:array<struct<{VERSION}>>>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).selectExpr(
        "inline(products)"
    )


def flatten_issues(products: DataFrame) -> DataFrame:
    """One row per issue; (version_no, part, kind_rank, row_ordinal) is its document order.

    ``part`` is null for documents that hold each version in one piece.
    """
    versions = products.select(
        F.col("id").alias("product_id"),
        F.col("name").alias("product_name"),
        F.posexplode("versions").alias("version_no", "_v"),
    )

    def tagged(kind, rank, field):
        none = F.array().cast(f"array<struct<{ISSUE}>>")
        return F.transform(
            F.coalesce(F.col(f"_v.{field}"), none),
            lambda i, n: F.struct(
                F.lit(kind).alias("issue_type"),
                F.lit(rank).alias("kind_rank"),
                n.alias("row_ordinal"),
                i.alias("_i"),
            ),
        )

    both = F.concat(tagged("known", 0, "known_issues"), tagged("addressed", 1, "addressed_issues"))
    rows = versions.select(
        "product_id",
        "product_name",
        F.col("_v.version").alias("version"),
        F.col("_v.part").alias("part"),
        F.col("_v.release_date").alias("version_release_date"),
        "version_no",
        F.explode(both).alias("_t"),
    )
    return rows.select(
        "product_id", "product_name", "version", "part", "version_release_date", "version_no",
        "_t.issue_type", "_t.kind_rank", "_t.row_ordinal", "_t._i.*",
    )


def read_releases(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    return spark.read.schema(RELEASE_SCHEMA).option("multiLine", multiline).json(path)


def release_changes(releases: DataFrame) -> DataFrame:
    return releases.select("version", "date", "title", F.explode("changes").alias("_c")).select(
        "version", "date", "title", "_c.type", "_c.description"
    )


def change_counts(releases: DataFrame) -> DataFrame:
    return release_changes(releases).groupBy("version", "type").agg(F.count("*").alias("n"))


def write_report(stats: DataFrame, failures: DataFrame, path: str) -> None:
    """A load report as two sets of JSON lines: counts per product, one line per failure."""
    stats.write.mode("overwrite").json(f"{path}/stats")
    failures.write.mode("overwrite").json(f"{path}/failures")


STATS_SCHEMA = (
    "product_id string, versions bigint, known bigint, addressed bigint, failed bigint, "
    "version_list array<string>"
)
FAILURE_SCHEMA = (
    "url string, error string, product_id string, version string, issue_type string"
)


def read_report(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return (
        spark.read.schema(STATS_SCHEMA).json(f"{path}/stats"),
        spark.read.schema(FAILURE_SCHEMA).json(f"{path}/failures"),
    )


def read_report_file(spark: SparkSession, path: str) -> DataFrame:
    """Failed pages of a report kept as one JSON document."""
    report = spark.read.schema(REPORT_SCHEMA).option("multiLine", True).json(path)
    return report.select(F.explode("failed_fetches").alias("_f")).select(
        "_f.url", "_f.error", F.col("_f.product").alias("product_id"), "_f.version", "_f.issue_type"
    )


def read_cache(spark: SparkSession, path: str, version: int = fixed.SNAPSHOT_SCHEMA_VERSION):
    """Cached work list entries; unreadable or foreign entries count as absent."""
    rows = (
        spark.read.schema(f"{CACHE_SCHEMA}, _corrupt string")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
        .json(path)
    )
    return rows.filter((F.col("_corrupt").isNull()) & (F.col("schema_version") == version)).drop(
        "_corrupt", "schema_version"
    )
