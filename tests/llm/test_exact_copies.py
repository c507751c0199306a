import hashlib
import random
import re

import pytest
from compare import agrees
from pyspark.sql import functions as F

from fixatlas.llm import exact_copies as ec
from fixatlas.llm.queries import EXPECTED, QUERIES


def slow(rows):
    groups = {}
    for at, (i, text) in enumerate(rows):
        bare = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        groups.setdefault(bare, []).append((-len(text or ""), i is None, i if i is not None else 0, at))
    out = []
    for bare, members in groups.items():
        best = min(members)
        for short, unknown, i, at in members:
            keep = None if best[1] else best[2]
            sha = hashlib.sha256(bare.encode()).hexdigest()
            out.append((None if unknown else i, keep, len(members), (short, unknown, i, at) == best, sha))
    return sorted(out, key=str)


def fast(df):
    return sorted(((r[0], r[1], r[2], r[3], bytes(r[4]).hex()) for r in ec.exact_copies(df).collect()), key=str)


SHAPE = "doc_id long, text string, digest int, run string, n int"


def test_odd_texts_against_brute_force(spark):
    r = random.Random(5)
    texts = [None, "", " \t\n", "a b", "ab", "a b", "a b", "é😀", "é 😀", "A b", "x" * 200_000, "x " * 200_000]
    rows = [(i, r.choice(texts)) for i in range(400)] + [(None, "ab"), (None, "only unknown"), (None, "only  unknown")]
    df = spark.createDataFrame([(*x, 1, "r", 2) for x in rows], SHAPE).repartition(7).cache()
    rows = [(x.doc_id, x.text) for x in df.collect()]
    assert fast(df) == slow(rows)


@pytest.mark.parametrize("run_rows, rounds", [(4, 3), (1 << 16, 1)])
def test_several_rounds_give_the_same(spark, monkeypatch, run_rows, rounds):
    monkeypatch.setattr(ec, "RUN_ROWS", run_rows)
    rows = [(i, "hot" if i % 3 == 0 else f"t{i % 50}" + " " * (i % 4)) for i in range(2000)]
    df = spark.createDataFrame([(*x, 1, "r", 2) for x in rows], SHAPE)
    assert ec.rounds_for(2000, 8) == rounds
    assert fast(df) == slow(rows)


def test_repeated_rows_keep_one(spark):
    df = spark.createDataFrame([(7, "a b", 0, "", 0)] * 5 + [(3, "ab", 0, "", 0)], SHAPE)
    found = ec.exact_copies(df).collect()
    assert [r.keep_id for r in found] == [7] * 6 and sum(r.kept for r in found) == 1


def test_a_digest_in_all_runs_meets_few_equal_ones_in_each_round(spark):
    digest = hashlib.sha256(b"hot").digest()
    runs = spark.range(256).select(
        F.col("id").alias("run"), F.lit(bytearray(digest)).alias("digest"), F.lit(3).alias("n_bytes"),
        F.struct((-F.col("id")).alias("short"), F.lit(False).alias("unknown"), "id", F.col("id").alias("at")).alias("best"),
        F.lit(1).cast("long").alias("n"),
    )
    once = ec.merged(runs, 0)
    twice = ec.merged(once, 1)
    assert [r.n for r in once.collect()] == [ec.FAN] * ec.FAN
    assert [(r.run, r.n, r.best.id) for r in twice.collect()] == [((digest[0] >> 4) + 16 * (digest[0] & 15), 256, 255)]


def test_empty_table(spark):
    assert ec.exact_copies(spark.createDataFrame([], SHAPE)).count() == 0


def test_query_against_sql(spark):
    agrees(spark, QUERIES["op12_exact_copies"], EXPECTED["op12_exact_copies"])
