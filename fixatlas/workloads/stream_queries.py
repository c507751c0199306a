"""Streams: the derived rows arrive in three increments, each processed by its own run."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from fixatlas.sources.scratch import fresh_folder
from fixatlas.streaming import intake, merging
from fixatlas.workloads.derived import PAGE_URL_SQL, WITH_FACTS, facts
from fixatlas.workloads.registry import query

INCREMENTS = ["A", "N", "R"]
_STEP = "case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end"
_LASTMOD = "case when l_tax = 0 then null else concat('v', v1) end"
_SEQ = f"cast({_STEP} as bigint) * 10000000000000000 + row_ordinal"


def _run_increments(spark, rows, run):
    """Adds one increment at a time to a folder and runs the stream over what is new."""
    source = fresh_folder(spark, "stream-in")
    columns = [c for c in rows.columns if c != "l_returnflag"]
    schema = rows.select(*columns).schema
    for flag in INCREMENTS:
        rows.filter(F.col("l_returnflag") == flag).select(*columns).write.mode("append").parquet(source)
        run(spark.readStream.schema(schema).parquet(source))


_EXPIRY_START = datetime(2024, 1, 1, tzinfo=timezone.utc)
_EXPIRY_HOURS = [0, 20, 50]  # with a lifetime of 24 h the last increment finds nothing recorded


@query("stream_expiry", WITH_FACTS + f""", s as (
  select product_id, {PAGE_URL_SQL} as url, {_LASTMOD} as lastmod, {_SEQ} as seq, {_STEP} as step
  from facts),
n as (select *, row_number() over (partition by product_id, url, step order by seq desc) as n from s),
l as (select *, lag(lastmod) over (partition by product_id, url order by step) as before
  from n where n = 1)
select product_id, url, lastmod, seq, cast(step as bigint) as batch from l
where step = 2 or lastmod is null or before is null or lastmod <> before""")
def stream_expiry(spark, data_dir):
    """As `stream_changed_pages`, with hours between the increments and a lifetime in between."""
    rows = facts(spark, data_dir).selectExpr(
        "product_id", f"{PAGE_URL_SQL} as url", f"{_LASTMOD} as lastmod", f"{_SEQ} as seq",
        "l_returnflag",
    )
    path, checkpoint = fresh_folder(spark, "gate"), fresh_folder(spark, "checkpoint")

    def clock(batch_id):
        return _EXPIRY_START + timedelta(hours=_EXPIRY_HOURS[batch_id])

    _run_increments(spark, rows, lambda s: intake.run_gate(s, path, checkpoint, 24, clock))
    return spark.read.schema(f"{intake.CHANGED_SCHEMA}, batch bigint").parquet(f"{path}/changed")


@query("stream_changed_pages", WITH_FACTS + f""", s as (
  select product_id, {PAGE_URL_SQL} as url, {_LASTMOD} as lastmod, {_SEQ} as seq, {_STEP} as step
  from facts),
n as (select *, row_number() over (partition by product_id, url, step order by seq desc) as n from s),
l as (select *, lag(lastmod) over (partition by product_id, url order by step) as before
  from n where n = 1)
select product_id, url, lastmod, seq, cast(step as bigint) as batch from l
where lastmod is null or before is null or lastmod <> before""")
def stream_changed_pages(spark, data_dir):
    rows = facts(spark, data_dir).selectExpr(
        "product_id", f"{PAGE_URL_SQL} as url", f"{_LASTMOD} as lastmod", f"{_SEQ} as seq",
        "l_returnflag",
    )
    path, checkpoint = fresh_folder(spark, "gate"), fresh_folder(spark, "checkpoint")
    _run_increments(spark, rows, lambda s: intake.run_gate(s, path, checkpoint))
    return spark.read.schema(f"{intake.CHANGED_SCHEMA}, batch bigint").parquet(f"{path}/changed")


@query("stream_state_expiry", WITH_FACTS + f""", s as (
  select product_id, {PAGE_URL_SQL} as url, {_LASTMOD} as lastmod, {_SEQ} as seq, {_STEP} as step from facts),
l as (select *, lag(lastmod) over w as before, lag(step) over w as then_
  from s window w as (partition by product_id, url order by seq))
select product_id, url, lastmod, seq from l
where lastmod is null or before is null or lastmod <> before or (step = 2 and then_ < 2)""")
def stream_state_expiry(spark, data_dir):
    """Every change of a page, in the order of its captures, against entries with a lifetime of 24 h."""
    hours = F.element_at(F.array(*map(F.lit, _EXPIRY_HOURS)), F.expr(f"{_STEP} + 1"))
    rows = facts(spark, data_dir).select(
        "product_id", F.expr(PAGE_URL_SQL).alias("url"), F.expr(_LASTMOD).alias("lastmod"),
        F.expr(_SEQ).alias("seq"),
        F.timestamp_seconds(F.lit(int(_EXPIRY_START.timestamp())) + hours * 3600).alias("seen_at"),
        "l_returnflag",
    )
    path, checkpoint = fresh_folder(spark, "changes"), fresh_folder(spark, "checkpoint")
    _run_increments(spark, rows, lambda s: intake.run_changes(s, path, checkpoint, 24))
    return intake.changes(spark, path)


_MERGED = ["product_id", "version", "issue_type", "bug_id", "page_ordinal", "row_ordinal"]


@query("stream_merge", WITH_FACTS + f""", s as (select {", ".join(_MERGED)}, l_returnflag from facts),
held as (select distinct product_id, version from s where l_returnflag = 'A' and issue_type = 'known')
select distinct {", ".join(_MERGED)} from s
where (product_id, version) not in (select (product_id, version) from held)""")
def stream_merge(spark, data_dir):
    """Rows of versions not held at the start; the first increment is delivered twice."""
    rows = facts(spark, data_dir).select(*_MERGED, "l_returnflag")
    held = rows.filter("l_returnflag = 'A' and issue_type = 'known'")
    path, checkpoint = fresh_folder(spark, "issues"), fresh_folder(spark, "checkpoint")
    again = rows.filter("l_returnflag = 'A'").withColumn("l_returnflag", F.lit("R"))
    _run_increments(
        spark, rows.unionByName(again), lambda s: merging.run_merge(s, path, checkpoint, _MERGED, held)
    )
    return merging.merged(spark, path).drop("batch")
