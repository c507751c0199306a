import itertools
import random
import re

from pyspark.sql import functions as F

from fixatlas.functions import versions as vx


def test_patch_key(apply):
    assert apply(vx.key_patch, ["6.2.8-h9", "6.1.0", "11.2.3.9", "9.2", "SaaS", "1.2.3-c471x2"]) == [
        [6, 2, 8, 9], [6, 1, 0, 0], [11, 2, 3, 0], [0] * 4, [0] * 4, [1, 2, 3, 471],
    ]


def test_other_keys(apply):
    assert apply(vx.key_calendar, ["2025.r5.0", "Unknown"]) == [[2025, 5, 0], [0, 0, 0]]
    assert apply(vx.key_edition, ["8.3-CE", "9.2", "x"]) == [[8, 3, 1], [9, 2, 0], [0, 0, 0]]
    assert apply(vx.key_major, ["11-2", "9-10"]) == [[11, 2], [9, 10]]
    assert apply(vx.major_of, ["26.2.1", "7"]) == ["26-2", None]


def pad_compare(a, b):
    """Comparison with missing segments filled in, written the long way round."""
    rank = {"SaaS": 2, "Unknown": 0}
    ra, rb = rank.get(a, 1), rank.get(b, 1)
    if ra != rb or ra != 1:
        return (ra > rb) - (ra < rb)

    def parts(v):
        m = re.match(r"^(.+?)-h(\d+)$", v, re.I)
        base, hot = (m[1], int(m[2])) if m else (v, 0)
        out = []
        for s in [s for s in re.sub("r", ".", base, flags=re.I).split(".") if s]:
            digits = re.match(r"\d*", s)[0]
            out.append((int(digits or 0), s[len(digits):]))
        return out, hot

    (pa, ha), (pb, hb) = parts(a), parts(b)
    for x, y in itertools.zip_longest(pa, pb, fillvalue=(0, "")):
        if x != y:
            return 1 if x > y else -1
    return (ha > hb) - (ha < hb)


def test_full_key_orders_like_the_padded_comparison(spark):
    rnd = random.Random(7)
    pool = ["SaaS", "Unknown", "10", "10.0", "10.0.0", "10.0.beta", "10.0.0-h1", "2025.r5.0", "r1"]
    pool += [
        ".".join(str(rnd.choice([0, 0, 1, 2, 10])) for _ in range(rnd.randint(1, 4)))
        + rnd.choice(["", "", "-h2", "-h10", "-c3", ".x"])
        for _ in range(90)
    ]
    pool = sorted(set(pool))
    df = spark.createDataFrame([(v,) for v in pool], "v string")
    keyed = df.select("v", vx.key_full(F.col("v")).alias("k"))
    a, b = keyed.alias("a"), keyed.alias("b")
    got = a.crossJoin(b).select(
        "a.v", "b.v",
        F.when(F.col("a.k") > F.col("b.k"), 1).when(F.col("a.k") < F.col("b.k"), -1).otherwise(0),
    ).collect()
    wrong = [(x, y, c) for x, y, c in got if pad_compare(x, y) != c]
    assert not wrong


def test_segment_key_has_no_special_versions(spark):
    df = spark.createDataFrame([(v,) for v in ["9.1", "10.0", "10", "12.1.5-h2", "12.1.5"]], "v string")
    order = [r[0] for r in df.orderBy(vx.key_segments(F.col("v")).desc(), "v").collect()]
    assert order == ["12.1.5-h2", "12.1.5", "10", "10.0", "9.1"]
