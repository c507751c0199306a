from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from fixatlas.streaming import intake, merging

PAGES = "product_id string, url string, lastmod string, seq long"


def feed(spark, folder, rows, schema=PAGES):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).parquet(folder)


STEPS = [
    [("p", "a", "d1", 1), ("p", "b", "d1", 2), ("p", "n", None, 3)],
    [("p", "a", "d1", 4), ("p", "b", "d2", 5), ("q", "a", "d1", 6), ("p", "n", None, 7)],
    [("p", "b", "d1", 8)],
]
EXPECTED = {1, 2, 3, 5, 6, 7, 8}


def test_stateful_changes(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / x) for x in ("in", "out", "ckpt"))
    for rows in STEPS:
        intake.run_available(intake.changed_pages(feed(spark, src, rows)), out, ckpt)
    assert {r.seq for r in spark.read.parquet(out).collect()} == EXPECTED


def test_expired_state_counts_as_new(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / x) for x in ("in", "out", "ckpt"))
    for seq in (1, 2):
        stream = intake.changed_pages(feed(spark, src, [("p", "a", "d1", seq)]), ttl_hours=0)
        intake.run_available(stream, out, ckpt)
    assert sorted(r.seq for r in spark.read.parquet(out).collect()) == [1, 2]


def test_state_lives_as_long_as_its_entry(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / x) for x in ("in", "out", "ckpt"))
    timed = PAGES + ", seen_at timestamp"
    hour = lambda h: datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(hours=h)
    steps = [
        [("p", "a", "d1", 1, hour(0)), ("p", "b", "d1", 2, hour(0)), ("p", "c", "d1", 3, hour(0))],
        [("p", "a", "d1", 4, hour(20)), ("p", "b", "d1", 5, hour(23)), ("p", "b", "d1", 6, hour(20))],
        # a was renewed 23 h ago, b longer ago than a lifetime, c was not renewed.
        [("p", "a", "d1", 7, hour(43)), ("p", "b", "d1", 8, hour(48)), ("p", "b", "d2", 9, hour(48)), ("p", "c", "d1", 10, hour(48))],
        [("p", "z", None, 11, hour(200))],
    ]
    for rows in steps:
        intake.run_available(intake.changed_pages(feed(spark, src, rows, timed), 24, "seen_at", "6 hours"), out, ckpt)
    assert {r.seq for r in spark.read.parquet(out).collect()} == {1, 2, 3, 8, 9, 10, 11}
    left = spark.read.format("statestore").load(ckpt).select("key.url").collect()
    assert [r.url for r in left] == ["z"]


def test_changes_batch_agrees_with_state_in_the_stream(spark, tmp_path):
    path = str(tmp_path / "out")
    timed = PAGES + ", seen_at timestamp"
    hour = lambda h: datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(hours=h)
    steps = [
        [("p", "a", "d1", 1, hour(0)), ("p", "b", "d1", 2, hour(0)), ("p", "c", "d1", 3, hour(0)), ("p", "n", None, 4, hour(0))],
        [("p", "a", "d1", 5, hour(20)), ("p", "b", "d2", 7, hour(20)), ("p", "b", "d1", 6, hour(23)), ("p", "n", None, 8, hour(20))],
        [("p", "a", "d1", 9, hour(43)), ("p", "b", "d2", 10, hour(44)), ("p", "c", "d1", 11, hour(48)), ("p", "n", "d1", 12, hour(21))],
        [],
    ]
    step = intake.changes_batch(path)
    for batch, rows in enumerate(steps):
        for _ in range(2):
            step(spark.createDataFrame(rows, timed), batch)
    got = [r.seq for r in intake.changes(spark, path).collect()]
    # b's entry is that of seq 7, seen at 20: a lifetime before 44.
    assert sorted(got) == [1, 2, 3, 4, 7, 8, 10, 11, 12]


def test_gate_matches_and_can_be_repeated(spark, tmp_path):
    src, path, ckpt = (str(tmp_path / x) for x in ("in", "out", "ckpt"))
    for rows in STEPS:
        intake.run_gate(feed(spark, src, rows), path, ckpt)
    step = intake.gate_batch(path)
    for _ in range(2):
        step(spark.createDataFrame(STEPS[2], PAGES), 2)
    got = spark.read.parquet(f"{path}/changed")
    assert {r.seq for r in got.collect()} == EXPECTED and got.count() == len(EXPECTED)


def test_gate_forgets_after_its_lifetime(spark, tmp_path):
    path = str(tmp_path / "out")
    step = intake.gate_batch(path, ttl_hours=0)
    for batch in (0, 1):
        step(spark.createDataFrame([("p", "a", "d1", batch)], PAGES), batch)
    assert spark.read.parquet(f"{path}/changed").count() == 2


MERGED = "product_id string, version string, bug_id string"
ROWS = [("p", "1", "A"), ("p", "1", "B"), ("p", "2", "C"), ("p", "2", "D"), ("p", "1", "A"), ("p", "2", "E"), ("p", "3", None), ("p", "3", "")]
KEY = ["product_id", "version", "bug_id"]


@pytest.mark.parametrize("cuts", [[8], [1, 2, 5, 8], [3, 8], [1, 2, 3, 4, 5, 6, 7, 8]])
def test_merge_does_not_depend_on_batches(spark, tmp_path, cuts):
    src, path, ckpt = (str(tmp_path / x) for x in ("in", "out", "ckpt"))
    held = spark.createDataFrame([("p", "2", "Z")], MERGED)
    for low, high in zip([0, *cuts], cuts):
        merging.run_merge(feed(spark, src, ROWS[low:high], MERGED), path, ckpt, KEY, held)
    got = sorted(((r.version, r.bug_id) for r in merging.merged(spark, path).collect()), key=str)
    assert got == [("1", "A"), ("1", "B"), ("3", ""), ("3", None)]


def test_merge_batches_are_idempotent(spark, tmp_path):
    path = str(tmp_path / "out")
    step = merging.merge_batch(path, KEY)
    for low, high, batch in ((0, 2, 0), (2, 6, 1), (2, 6, 1), (6, 8, 2), (2, 6, 1)):
        step(spark.createDataFrame(ROWS[low:high], MERGED), batch)
    got = merging.merged(spark, path).collect()
    assert sorted(((r.bug_id, r.batch) for r in got), key=str) == [("", 2), ("A", 0), ("B", 0), ("C", 1), ("D", 1), ("E", 1), (None, 2)]


def test_merge_opens_only_keys_of_its_versions(spark, tmp_path):
    path = str(tmp_path / "out")
    many = [("p", str(v), f"A-{k}") for v in range(200) for k in range(3)]
    step = merging.merge_batch(path, KEY, spark.createDataFrame([("q", "1", "Z")], MERGED))
    step(spark.createDataFrame(many, MERGED), 0)
    one = spark.createDataFrame(many[:4] + [("p", "0", "new"), ("q", "1", "Y")], MERGED)
    place = merging._place(merging.BUCKETS)
    met = [r[0] for r in one.select(place).distinct().collect()]
    held = merging.seen_keys(spark, path, 1, met)
    assert len(met) <= 3 and 6 <= held.count() < 120
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert "bucket#" in plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    opened = held.select(F.input_file_name().alias("f")).distinct().count()
    assert opened <= 3 < len(spark.read.parquet(f"{path}/keys").inputFiles())
    step(one, 1)
    assert [r.bug_id for r in merging.merged(spark, path).filter("batch = 1").collect()] == ["new"]
    # Held versions are those of the start, whatever the table has become.
    again = merging.merge_batch(path, KEY, spark.createDataFrame([("p", "0", "Z")], MERGED))
    again(spark.createDataFrame([("p", "0", "newer"), ("q", "1", "X")], MERGED), 2)
    assert [r.bug_id for r in merging.merged(spark, path).filter("batch = 2").collect()] == ["newer"]
    with pytest.raises(ValueError, match="identity"):
        merging.merge_batch(path, ["bug_id"])
