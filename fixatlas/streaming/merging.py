"""Continuous merge of extracted issues into the held table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fixatlas.operators.merge import VERSION_KEY, existing_versions

HELD_BATCH = "batch"
BUCKET, BUCKETS = "bucket", 64


def _digest(identity: list[str]):
    """256 bits for the columns that tell an issue from others, nulls told from empty texts."""
    return F.sha2(F.to_json(F.struct(*identity), {"ignoreNullFields": "false"}), 256)


def _place(buckets: int):
    """Bucket of an issue's version: a batch brings few versions, so it meets few buckets."""
    return F.pmod(F.xxhash64(*VERSION_KEY), F.lit(buckets)).cast("int")


def seen_keys(spark: SparkSession, path: str, before_batch: int, buckets: list[int]) -> DataFrame:
    """Keys that batches before ``before_batch`` have delivered, of some buckets; others are not opened."""
    return (
        spark.read.schema(f"key string, {HELD_BATCH} bigint, {BUCKET} int")
        .option("basePath", f"{path}/keys").parquet(f"{path}/keys")
        .filter((F.col(HELD_BATCH) < before_batch) & F.col(BUCKET).isin(buckets)).select("key")
    )


def merge_batch(path: str, identity: list[str], held: DataFrame | None = None, buckets: int = BUCKETS):
    """``foreachBatch`` step: versions of ``held`` win, of equal issues the first one stays.

    ``held`` is the table as it was when the stream began: its versions are stored by the first batch,
    and later ones read only those. What the stream itself has added does
    not close a version, so its rows may come in any number of batches. An issue that was
    delivered before (equal in ``identity``, which has to contain product and version) is not added
    again; only digests are kept and compared for that. They lie in folders by bucket of their
    version, and a batch opens the buckets of its own versions. A batch that is run again after a
    failure reads only earlier batches and replaces its own partitions, so repeating it changes
    nothing. ``buckets`` has to stay the same for all batches of a path.
    """
    if not set(VERSION_KEY) <= set(identity):
        raise ValueError(f"identity has to contain {VERSION_KEY}")

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumn("key", _digest(identity)).withColumn(BUCKET, _place(buckets))
        if held is not None:
            if batch_id == 0:
                existing_versions(held).write.mode("overwrite").parquet(f"{path}/held")
            closed = spark.read.schema(held.select(*VERSION_KEY).schema).parquet(f"{path}/held")
            new = new.join(closed, VERSION_KEY, "left_anti")
        if batch_id > 0:
            # At most ``buckets`` numbers.
            met = [r[0] for r in batch.select(_place(buckets).alias(BUCKET)).distinct().collect()]
            new = new.join(seen_keys(spark, path, batch_id, met), "key", "left_anti")
        new = new.dropDuplicates(["key"])
        rows = f"{path}/rows/{HELD_BATCH}={batch_id}"
        new.write.mode("overwrite").parquet(rows)
        written = spark.read.schema(new.schema).parquet(rows).select("key", BUCKET)
        # One file for each bucket of the batch, unless it is very large.
        written.repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(
            f"{path}/keys/{HELD_BATCH}={batch_id}"
        )

    return step


def run_merge(
    stream: DataFrame, path: str, checkpoint: str, identity: list[str], held: DataFrame | None = None
) -> None:
    query = (
        stream.writeStream.foreachBatch(merge_batch(path, identity, held))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def merged(spark: SparkSession, path: str) -> DataFrame:
    """Rows the stream has added, each with the batch that brought it first."""
    return spark.read.parquet(f"{path}/rows").drop("key", BUCKET).withColumn(
        HELD_BATCH, F.col(HELD_BATCH).cast("bigint")
    )
