"""Page corpus: fetch attempts to usable pages, usable pages to document lists."""

from __future__ import annotations

import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fixatlas.sources.html_tree import read_page

# What `parse_pages` can add to a page, as Spark DDL.
DOCUMENT_PARTS = {
    "title": "string",
    "raw_title": "string",
    "headings": "array<struct<ord:int,tag:string,fused:string,spaced:string>>",
    "links": "array<struct<ord:int,href:string,text:string>>",
    "tables": (
        "array<struct<ord:int,has_head:boolean,has_body:boolean,rows:array<struct<"
        "section:string,cells:array<struct<tag:string,spaced:string,fused:string,"
        "parts:array<string>>>>>>>"
    ),
    "topics": (
        "array<struct<ord:int,title:string,shortdesc:string,paras:array<struct<"
        "text:string,bold:string,after_bold:string,tt:string>>>>"
    ),
    "aria": "array<struct<ord:int,headers:array<string>,rows:array<array<string>>>>",
}


def fetch_outcome(status: Column) -> Column:
    return (
        F.when(status == 200, "usable")
        .when(status.isin(404, 410), "gone")
        .otherwise("transient")
    )


def latest_attempts(pages: DataFrame, keys=("url",)) -> DataFrame:
    """One row per URL: the latest usable attempt, else the latest attempt at all.

    ``row_number() = 1`` lets Spark cut every key to one row before the shuffle, so
    a URL with many attempts does not travel, nor end up as one big window.
    """
    outcome = fetch_outcome(F.col("status"))
    order = Window.partitionBy(*keys).orderBy(
        F.when(outcome == "usable", 0).otherwise(1), F.col("attempt").desc()
    )
    return (
        pages.withColumn("outcome", outcome)
        .withColumn("_n", F.row_number().over(order))
        .filter("_n = 1")
        .drop("_n")
    )


def usable_pages(pages: DataFrame, keys=("url",)) -> DataFrame:
    return latest_attempts(pages.filter(fetch_outcome(F.col("status")) == "usable"), keys)


def _arrow_type(dtype: T.DataType) -> pa.DataType:
    if isinstance(dtype, T.ArrayType):
        return pa.list_(_arrow_type(dtype.elementType))
    if isinstance(dtype, T.StructType):
        return pa.struct([(f.name, _arrow_type(f.dataType)) for f in dtype])
    return {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}[
        dtype.simpleString()
    ]


def parse_pages(pages: DataFrame, *parts: str, html: str = "html") -> DataFrame:
    """Replace the ``html`` column by the requested document lists.

    Runs as ``mapInArrow``: each page is read exactly once whatever the plan around
    it looks like, text stops at this point, and only the lists asked for are
    built.  Arrow batches are bounded in bytes by the session
    (``spark.sql.execution.arrow.maxBytesPerBatch``), so large pages are safe.
    """
    return _parsed(pages, html, parts, lambda batch: [parts] * batch.num_rows)


def parse_pages_by(pages: DataFrame, choice: str, wanted: dict[str, tuple[str, ...]], html: str = "html") -> DataFrame:
    """``parse_pages`` with the lists that each page needs by its value of ``choice``.

    All pages go through one pass; lists that a page doesn't need are null.
    """
    parts = tuple(dict.fromkeys(p for chosen in wanted.values() for p in chosen))
    return _parsed(pages, html, parts, lambda batch: [wanted.get(c, ()) for c in batch.column(choice).to_pylist()])


def _parsed(pages: DataFrame, html: str, parts: tuple[str, ...], parts_of) -> DataFrame:
    kept = [f for f in pages.schema if f.name != html]
    added = T.StructType([T.StructField(p, T.DataType.fromDDL(DOCUMENT_PARTS[p])) for p in parts])
    arrow = {p: _arrow_type(added[p].dataType) for p in parts}
    names = [f.name for f in kept]

    def read(batches):
        for batch in batches:
            # Page trees hold no cycles; tracking them only costs time. Off for this batch only.
            tracked = gc.isenabled()
            gc.disable()
            try:
                docs = [
                    read_page(h, own) if h is not None and own else {}
                    for h, own in zip(batch.column(html).to_pylist(), parts_of(batch))
                ]
            finally:
                if tracked:
                    gc.enable()
            columns = [batch.column(n) for n in names]
            columns += [pa.array([d.get(p) for d in docs], type=arrow[p]) for p in parts]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *parts])

    return pages.select(*names, html).mapInArrow(read, T.StructType([*kept, *added.fields]))


def valid_landing_pages(parsed: DataFrame) -> DataFrame:
    """Pages that really are landing pages: an ``h1``, and no error in the title."""
    title = F.lower(F.coalesce(F.col("title"), F.lit("")))
    return parsed.filter(
        F.exists("headings", lambda h: h["tag"] == "h1")
        & ~title.contains("404")
        & ~title.contains("not found")
        & ~title.contains("error")
    )
