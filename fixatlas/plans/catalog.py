"""Issues stored in document order, with positions for paging and letter triples for search.

A catalog is a folder of tables. ``rows`` holds the issues in slices of document order, one
folder a slice, each row with its place in the slice. ``slices`` says how many rows each slice has and how
many stand before it. ``triples`` lists, for every three letters in a row that occur in the searched text, the
slices in which they do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fixatlas import fixed
from fixatlas.operators import search
from fixatlas.plans import cards

SLICE_ROWS = 100_000
_PLACES = 33  # bits of a row's number within its partition
_CUTS = 14  # bits of a slice's number within its partition


def catalog_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(spark.read.parquet(f"{path}/shape").schema).parquet(f"{path}/rows")


def write_catalog(issues: DataFrame, path: str, slice_rows: int = SLICE_ROWS) -> None:
    """Stores ``issues``; a slice holds at most ``slice_rows`` rows however many are equal.

    Small slices are cut from sorted partitions of ``SLICE_ROWS`` rows: a partition for each would have the
    driver sample rows for every one of them, and take a report from every task.
    """
    spark = issues.sparkSession
    parts = max(-(-issues.count() // max(slice_rows, SLICE_ROWS)), 1)
    rows = cards.placed(issues).withColumn("search_text", search.search_text(issues))
    # The number of the row as it is read parts equal rows, which no sort key can.
    dealt = rows.withColumn("_at", F.monotonically_increasing_id()).repartitionByRange(parts, *cards.ORDER, "_at")
    ordered = dealt.sortWithinPartitions(*cards.ORDER).drop("_at").withColumn("_at", F.monotonically_increasing_id())
    number = F.col("_at").bitwiseAND((1 << _PLACES) - 1)
    cut = F.floor(number / slice_rows)
    rows = ordered.select(
        *issues.columns, "search_text", (number % slice_rows).alias("place"),
        (F.shiftleft(F.shiftright("_at", _PLACES), _CUTS) + cut).cast("int").alias("slice"),
    )
    rows.write.partitionBy("slice").parquet(f"{path}/rows")
    # An empty table for the columns: without rows there is no slice to read them from.
    spark.createDataFrame([], rows.schema).write.parquet(f"{path}/shape")

    stored = catalog_rows(spark, path)
    # One row for each slice: their number is the writer's choice.
    counts = stored.groupBy("slice").agg(F.count("*").alias("n"))
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    counts.select("slice", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")).write.parquet(f"{path}/slices")

    text = F.col("search_text")
    threes = F.transform(F.sequence(F.lit(1), F.length(text) - 2), lambda i: F.substring(text, i, 3))
    triples = stored.where(F.length(text) >= 3).select("slice", F.explode(F.array_distinct(threes)).alias("triple")).distinct()
    spread = triples.repartitionByRange(parts, "triple", "slice").sortWithinPartitions("triple", "slice")
    spread.write.parquet(f"{path}/triples")


def open_page(spark: SparkSession, path: str, page: int, size: int = fixed.PAGE_SIZE) -> DataFrame:
    """Rows of a page with their ``position`` from 0; a page past the end is the last one.

    Only the slices that hold the page are read, the same few for the first page and the millionth.
    """
    slices = spark.read.parquet(f"{path}/slices")
    total = slices.agg(F.max(F.col("first") + F.col("n"))).first()[0] or 0
    low = max(min(page, -(-total // size)) - 1, 0) * size
    held = slices.where((F.col("first") < low + size) & (F.col("first") + F.col("n") > low)).collect()  # those of one page
    rows = catalog_rows(spark, path).where(F.col("slice").isin([s.slice for s in held]))
    first = F.coalesce(*[F.when(F.col("slice") == s.slice, F.lit(s.first)) for s in held]) if held else F.lit(0)
    placed = rows.withColumn("position", first + F.col("place")).where((F.col("position") >= low) & (F.col("position") < low + size))
    return placed.drop("slice", "place", "search_text").orderBy("position")


def candidate_slices(spark: SparkSession, path: str, term: str) -> DataFrame | None:
    """Slices that hold every letter triple of ``term``; None where it has none."""
    wanted = sorted({term[i : i + 3] for i in range(len(term) - 2)})
    if not wanted:
        return None
    triples = spark.read.parquet(f"{path}/triples").where(F.col("triple").isin(wanted))
    return triples.groupBy("slice").agg(F.count("*").alias("n")).where(F.col("n") == len(wanted)).select("slice")


def search_catalog(spark: SparkSession, path: str, term: str = "", **facets) -> DataFrame:
    """``search`` over a catalog: slices without one of the term's letter triples are not opened.

    A term under three letters looks through all of them.
    """
    rows = catalog_rows(spark, path)
    slices = candidate_slices(spark, path, term.lower())
    if slices is not None:
        rows = rows.join(slices, "slice", "left_semi")
    return search.search(rows, term, **facets).drop("slice", "place", "search_text")
