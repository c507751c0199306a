import hashlib
import random
import re

import pytest

from fixatlas.llm.queries import QUERIES
from fixatlas.llm.suffix_search import decontaminate, overlaps

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, tests, window):
    out = {}
    for key, text in docs:
        mine, hit, items, longest = words(text), set(), set(), 0
        for name, other in tests:
            theirs = words(other)
            size = min(window, len(theirs))
            if not size:
                continue
            places = range(len(theirs) - size + 1)
            wanted = {tuple(theirs[i : i + size]) for i in places}
            for p in range(len(mine) - size + 1):
                if tuple(mine[p : p + size]) in wanted:
                    hit |= set(range(p, p + size))
                    items.add("null" if name is None else str(name))
                    for i in places:
                        n = 0
                        while p + n < len(mine) and i + n < len(theirs) and mine[p + n] == theirs[i + n]:
                            n += 1
                        longest = max(longest, n)
        out[key] = (len(mine), len(hit), sorted(items), longest)
    return out


def made(seed, window):
    r = random.Random(seed)
    vocabulary = ["a", "b", "the", "of", "ñ", "É", "x1", "zz"]
    text = lambda n: "".join(w + r.choice([" ", ", ", "\n", "--"]) for w in r.choices(vocabulary, k=n))
    tests = [(i, text(r.randint(1, 3 * window))) for i in range(12)]
    tests += [(100, ""), (101, None), (102, "!!"), (None, text(4)), (3, text(window + 2)), (5, tests[5][1])]
    docs = [(i, text(r.randint(0, 60))) for i in range(40)]
    docs += [(200 + i, text(5) + (t or "").upper() + text(3)) for i, (_, t) in enumerate(tests)]
    docs += [(300, None), (301, ""), (302, " ".join(["the"] * 3000)), (303, docs[3][1]), (304, "x" * 100_000)]
    return docs, tests


@pytest.mark.parametrize("seed,window,block", [(1, 4, 1 << 20), (2, 3, 60), (3, 10, 200), (4, 2, 1)])
def test_against_brute_force(spark, seed, window, block):
    docs, tests = made(seed, window)
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n_hit int").repartition(3)
    bench = spark.createDataFrame(tests, "item_id long, text string")
    found = overlaps(df, bench, window=window, block_bytes=block).collect()
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"], r.longest_words) for r in found}
    assert len(found) == len(docs) and got == brute(docs, tests, window)


def test_removal_keeps_columns_and_clean_documents(spark):
    docs, tests = made(7, 5)
    df = spark.createDataFrame([(*d, "own") for d in docs], "doc_id long, text string, items string")
    kept = decontaminate(df, spark.createDataFrame(tests, "item_id long, text string"), window=5)
    assert kept.columns == df.columns
    want = [k for k, v in brute(docs, tests, 5).items() if v[1] == 0]
    rows = kept.collect()
    assert sorted(r.doc_id for r in rows) == sorted(want) and {r["items"] for r in rows} == {"own"}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    tests = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert overlaps(none, tests).count() == 0
    assert overlaps(some, tests.where("false")).first().n_hit == 0
    assert overlaps(some, tests).first().n_hit == 2


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    tests = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    # Only documents that share a window's text at all need the slow way.
    want = brute(docs, tests, 10) if len(docs) <= 300 else {}
    for r in QUERIES["op1_suffix_search"](spark, sf).collect():
        n, hit, items, _ = want[r.doc_id]
        digest = hashlib.sha256(",".join(items).encode()).hexdigest()
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, hit, len(items), digest, hit > 0)
