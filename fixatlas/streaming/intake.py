"""Incremental intake as Structured Streaming jobs.

`gate_batch` is the one to use for crawls: per micro-batch it is the same anti join as
the batch gate, all in the JVM, and its state is a table others can read.
`changed_pages` keeps the state in the stream itself, keyed by page and with a lifetime for each
entry, for continuous feeds where every single change matters; it costs a Python call per URL of a batch.
`changes_batch` gives the same changes at the cost of the gate, from entries in a table.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fixatlas import fixed
from fixatlas.operators.discovery import changed_urls

CHANGED_SCHEMA = "product_id string, url string, lastmod string, seq bigint"
_STATE = "lastmod string, seen_ms bigint"


def _emit_changed(ttl_ms: int):
    def step(key, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        # Plain lists: a page has few captures in a batch, for which frames cost more than the work.
        rows = sorted(
            (r for batch in batches for r in zip(batch["seq"].tolist(), batch["seen_ms"].tolist(), batch["lastmod"].tolist())),
            key=lambda r: r[0],
        )
        last, seen = state.get if state.exists else (None, None)
        changed = []
        for seq, now, lastmod in rows:
            lastmod = None if pd.isna(lastmod) else lastmod
            # A page without an entry, or with one that was not renewed in time, counts as new.
            if lastmod is None or last != lastmod or now - seen >= ttl_ms:
                changed.append((*key, lastmod, seq))
            last, seen = lastmod, now
        state.update((last, seen))
        # Never before the watermark, which rows of one batch may have passed already.
        state.setTimeoutTimestamp(max(seen + ttl_ms, state.getCurrentWatermarkMs() + 1))
        if changed:
            yield pd.DataFrame(changed, columns=["product_id", "url", "lastmod", "seq"])

    return step


def changed_pages(
    pages: DataFrame, ttl_hours: int = fixed.CACHE_TTL_HOURS, seen_at: str | None = None, late: str = "1 hour"
) -> DataFrame:
    """Pages of a stream whose last-modified text differs from the one seen before.

    State is one text and one time per (product, URL). An entry that is not renewed within the
    lifetime counts no more, and is removed from the state once the watermark has passed it, so
    the state holds the pages of one lifetime, not all that were ever seen. A page without a date
    always passes; captures of a page in one batch are looked at in the order of ``seq``.

    ``seen_at`` names the column with the time of a capture; captures later than ``late`` are
    dropped by the watermark. Without it the clock is the arrival of a batch: it never runs behind, so
    no page is late, and unlike a processing-time timeout it lets an ``availableNow`` run end.
    """
    seen = F.current_timestamp() if seen_at is None else F.col(seen_at)
    arrived = pages.select("product_id", "url", "lastmod", "seq", seen.alias("seen_at"))
    return (
        arrived.withWatermark("seen_at", late)
        .withColumn("seen_ms", F.unix_millis("seen_at"))
        .groupBy("product_id", "url")
        .applyInPandasWithState(
            _emit_changed(ttl_hours * 3_600_000),
            CHANGED_SCHEMA,
            _STATE,
            "append",
            GroupStateTimeout.EventTimeTimeout,
        )
    )


def gate_batch(path: str, ttl_hours: int = fixed.CACHE_TTL_HOURS, clock=None):
    """``foreachBatch`` step that keeps a manifest and writes the pages that changed.

    Of several captures of a page in one batch the latest counts.  A batch reads only
    what earlier batches recorded within the lifetime and replaces only its own
    folders, so running it again after a failure gives the same result.  The manifest is
    laid out by day, so days before the lifetime are not opened, and can be deleted.
    ``clock`` gives the time of a batch (UTC); now by default.
    """
    manifest_path, changed_path = f"{path}/manifest", f"{path}/changed"
    schema = f"{CHANGED_SCHEMA}, seen_at timestamp, day date, batch bigint"
    clock = clock or (lambda batch_id: datetime.now(timezone.utc))

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        newest = Window.partitionBy("product_id", "url").orderBy(F.col("seq").desc())
        now = clock(batch_id)
        oldest = now - timedelta(hours=ttl_hours)

        def latest(df):
            return df.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")

        due = seen = latest(batch.select("product_id", "url", "lastmod", "seq"))
        if batch_id > 0:
            recorded = (
                spark.read.schema(schema).option("basePath", manifest_path).parquet(manifest_path)
                .filter(
                    (F.col("day") >= F.lit(oldest.date())) & (F.col("batch") < batch_id)
                    & (F.col("seen_at") > F.lit(oldest))
                )
            )
            due = changed_urls(seen, latest(recorded))
        due.write.mode("overwrite").parquet(f"{changed_path}/batch={batch_id}")
        seen.withColumn("seen_at", F.lit(now)).write.mode("overwrite").parquet(
            f"{manifest_path}/day={now.date()}/batch={batch_id}"
        )

    return step


def changes_batch(path: str, ttl_hours: int = fixed.CACHE_TTL_HOURS, seen_at: str = "seen_at"):
    """``foreachBatch`` step that writes every change of a page, and its last capture as its entry.

    Captures of a page in one batch are looked at in the order of ``seq``, behind the page's
    newest entry of earlier batches. An entry that was not renewed within the lifetime counts no
    more: folders are by day, and days that ended a lifetime before the batch are not opened and
    can be deleted. No capture counts as late. A batch that is run again reads only earlier
    batches and replaces its own folder.
    """
    entries = f"{path}/entries"
    schema = f"{CHANGED_SCHEMA}, seen_ms bigint, changed boolean, last boolean, batch bigint, day date"
    page, ttl_ms = ["product_id", "url"], ttl_hours * 3_600_000

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(
            *page, "lastmod", "seq", F.unix_millis(seen_at).alias("seen_ms"), F.lit(True).alias("new")
        )
        first = rows.agg(F.min("seen_ms")).first()[0]
        if batch_id > 0 and first is not None:
            alive = first - ttl_ms
            held = (
                spark.read.schema(schema).option("basePath", entries).parquet(entries)
                .filter(
                    (F.col("batch") < batch_id) & F.col("last") & (F.col("seen_ms") > alive)
                    & (F.col("day") >= F.to_date(F.timestamp_millis(F.lit(alive))))
                )
                .groupBy(*page).agg(F.max(F.struct("batch", "seq", "seen_ms", "lastmod")).alias("_e"))
                .select(*page, "_e.lastmod", "_e.seq", "_e.seen_ms", F.lit(False).alias("new"))
            )
            rows = rows.unionByName(held)
        order = Window.partitionBy(*page).orderBy("new", "seq")
        before, then = F.lag("lastmod").over(order), F.lag("seen_ms").over(order)
        known = F.col("lastmod").isNotNull() & before.eqNullSafe(F.col("lastmod"))
        out = rows.select(
            *page, "lastmod", "seq", "seen_ms", "new",
            (~known | F.coalesce(F.col("seen_ms") - then >= ttl_ms, F.lit(True))).alias("changed"),
            F.lead("seq").over(order).isNull().alias("last"),
        )
        kept = out.filter("new and (changed or last)").drop("new")
        dated = kept.withColumn("day", F.to_date(F.timestamp_millis("seen_ms")))
        dated.write.mode("overwrite").partitionBy("day").parquet(f"{entries}/batch={batch_id}")

    return step


def run_changes(
    stream: DataFrame, path: str, checkpoint: str, ttl_hours: int = fixed.CACHE_TTL_HOURS, seen_at: str = "seen_at"
) -> None:
    """Processes what is there and stops; output and progress are on shared storage."""
    query = (
        stream.writeStream.foreachBatch(changes_batch(path, ttl_hours, seen_at))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def changes(spark: SparkSession, path: str) -> DataFrame:
    """What `changes_batch` has found."""
    rows = spark.read.schema(f"{CHANGED_SCHEMA}, changed boolean").parquet(f"{path}/entries")
    return rows.filter("changed").select("product_id", "url", "lastmod", "seq")


def run_gate(
    stream: DataFrame, path: str, checkpoint: str, ttl_hours: int = fixed.CACHE_TTL_HOURS, clock=None
) -> None:
    """Processes what is there and stops; output and progress are on shared storage."""
    query = (
        stream.writeStream.foreachBatch(gate_batch(path, ttl_hours, clock))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def run_available(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Processes what is there and stops; output and progress are on shared storage."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
