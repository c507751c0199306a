"""Sitemap files: plain URL sets and the two-level index of documentation spaces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fixatlas.functions import urls as ux
from fixatlas.functions.text import strip


def read_urlset(spark: SparkSession, path: str) -> DataFrame:
    """``url, lastmod`` of all ``<url>`` entries; entries without a location are skipped."""
    rows = (
        spark.read.format("xml")
        .option("rowTag", "url")
        .schema("loc string, lastmod string")
        .load(path)
    )
    return rows.select(strip(F.col("loc")).alias("url"), strip(F.col("lastmod")).alias("lastmod")).filter(
        "url <> ''"
    )


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """``sitemap_url, space`` of the release-note spaces named by a sitemap index."""
    rows = spark.read.format("xml").option("rowTag", "sitemap").schema("loc string").load(path)
    url = strip(F.col("loc"))
    return rows.select(url.alias("sitemap_url"), ux.space_path(url).alias("space")).filter(
        ux.is_release_space(F.col("space"))
    )


def space_pages(index: DataFrame, page_sets: DataFrame) -> DataFrame:
    """Issue pages of the chosen spaces; ``page_sets`` holds ``space, url, lastmod``."""
    return page_sets.join(index.select("space"), "space", "left_semi").withColumn(
        "kind", ux.page_kind_loose(F.col("url"))
    ).filter("kind is not null")
