"""Manifest and baseline tables on storage.

Both are plain Parquet folders.  An update never rewrites the folder it reads: it
is written beside it and becomes current when the caller swaps the name, so a lost
executor or a failed job leaves the old table as it was.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fixatlas import fixed
from fixatlas.operators import baseline
from fixatlas.operators.merge import upsert_manifest

MANIFEST_SCHEMA = "product_id string, url string, lastmod string, seq bigint"


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The recorded pages; a manifest that does not exist yet is empty."""
    try:
        return spark.read.schema(MANIFEST_SCHEMA).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST_SCHEMA)


def save_manifest(manifest: DataFrame, seen: DataFrame, new_path: str) -> None:
    upsert_manifest(manifest, seen).write.mode("overwrite").parquet(new_path)


def save_baseline(issues: DataFrame, path: str) -> None:
    """Counts with digests, and identifiers, of each version of a data set, stamped with the format version."""
    stamp = F.lit(fixed.SNAPSHOT_SCHEMA_VERSION).alias("schema_version")
    counts = baseline.fingerprint(issues, digest=True)
    counts.select("*", stamp).write.mode("overwrite").parquet(f"{path}/counts")
    baseline.bug_ids(issues).select("*", stamp).write.mode("overwrite").parquet(f"{path}/ids")


def _checked(df: DataFrame) -> DataFrame:
    version = F.col("schema_version")
    message = F.concat(F.lit("unsupported baseline schema_version "), version.cast("string"))
    wrong = version != fixed.SNAPSHOT_SCHEMA_VERSION
    return df.filter(F.when(wrong, F.raise_error(message)).otherwise(F.lit(True))).drop(
        "schema_version"
    )


def load_baseline(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Counts and identifiers; reading a baseline of another format fails."""
    counts = _checked(spark.read.parquet(f"{path}/counts")).drop(*baseline.DIGEST)
    return counts, _checked(spark.read.parquet(f"{path}/ids"))


def load_digests(spark: SparkSession, path: str) -> DataFrame:
    """Digests of the identifiers of each version that has any; they lie with the counts."""
    counts = _checked(spark.read.parquet(f"{path}/counts")).filter("n_bug_ids > 0")
    return counts.select(*baseline.VERSION, F.col("n_bug_ids").alias("n_ids"), *baseline.DIGEST[1:])
