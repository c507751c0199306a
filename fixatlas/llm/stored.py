"""Intermediate tables in the shared folder, so that lost executors cost no recomputation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fixatlas.sources.scratch import fresh_folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back."""
    spark = df.sparkSession
    where = fresh_folder(spark, name)
    df.write.parquet(where)
    return spark.read.schema(df.schema).parquet(where)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
