import hashlib
import random

import numpy as np
import pytest

from fixatlas.llm import repeats
from fixatlas.llm.queries import QUERIES
from fixatlas.llm.repeats import anchors, equal_windows, remove_repeats


def brute(rows, depth=50):
    least = {}
    rank = lambda i: -(10**18) if i is None else i
    for doc_id, text in rows:
        raw = (text or "").encode()
        for s in range(len(raw) - depth + 1):
            w = raw[s : s + depth]
            least[w] = min(least.get(w, 10**18), rank(doc_id))
    out = []
    for doc_id, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - depth + 1):
            if least[raw[s : s + depth]] < rank(doc_id):
                gone[s : s + depth] = b"\1" * depth
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc_id, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(
        [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in df.collect()], key=str
    )


def rows_of(seed, n):
    r = random.Random(seed)
    alphabet = ["a", "b", "the ", "ñ", "\n", "日"]
    text = lambda k: "".join(r.choices(alphabet, k=k))
    passages = [text(40) for _ in range(3)] + ["ab" * 60, "x" * 200]
    rows = []
    for i in range(n):
        body = text(r.randint(0, 60))
        for _ in range(r.randint(0, 2)):
            p = r.choice(passages)
            a = r.randint(0, len(p) // 2)
            body += p[a:] + text(r.randint(0, 20))
        rows.append((r.randint(0, 3 * n), body))
    rows += [(5, rows[0][1]), (5, rows[0][1]), (None, rows[1][1]), (7, None), (8, ""), (9, "é" * 49), (10, "é" * 49), (11, "y" * 49), (12, "y" * 49), (1, "z " * 3000), (2, "z " * 3000 + "!")]
    return rows


@pytest.mark.parametrize("seed,parts,block", [(1, 1, 1 << 20), (2, 7, 500), (3, 4, 3000)])
def test_against_brute_force(spark, monkeypatch, seed, parts, block):
    monkeypatch.setattr(repeats, "BLOCK_BYTES", block)
    monkeypatch.setattr(repeats, "CHUNK", 97)
    rows = rows_of(seed, 60)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_bytes int").repartition(parts)
    # The limits are read in the worker as well; there they keep their own values.
    assert got(remove_repeats(df)) == brute(rows)


def test_blocks_of_one_document(spark):
    rows = rows_of(9, 25)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(len(rows))
    assert got(remove_repeats(df)) == brute(rows)


def test_equal_windows_have_equal_anchors(monkeypatch):
    r = random.Random(4)
    passage = bytes(r.choices(b"abc ", k=300))
    data = np.frombuffer(b"q" * 33 + passage + b"aab" * 40 + passage + b"zz", np.uint8)
    for chunk in (1 << 17, 61):
        monkeypatch.setattr(repeats, "CHUNK", chunk)
        first, last, place, hashes = anchors(data, np.array([0, len(data)]))
        of = {s: (h, p - s) for a, b, p, h in zip(first, last, place, hashes) for s in range(a, b + 1)}
        assert sorted(of) == list(range(len(data) - 49))
        seen = {}
        for s in of:
            assert of[s] == seen.setdefault(data[s : s + 50].tobytes(), of[s])


def test_groups_are_the_equal_windows():
    rng = np.random.default_rng(6)
    data = np.append(rng.integers(97, 99, 4000).astype(np.uint8), np.zeros(8, np.uint8))
    data[2000:2100] = data[100:200]
    starts = rng.permutation(3900)
    order, group = equal_windows(data, starts, np.zeros(3900, np.int64), 30)
    want = {}
    for s in starts.tolist():
        want.setdefault(data[s : s + 30].tobytes(), set()).add(s)
    want = {frozenset(v) for v in want.values() if len(v) > 1}
    found = {}
    for i, g in zip(order, group):
        found.setdefault(g, set()).add(int(starts[i]))
    assert {frozenset(v) for v in found.values()} == want and len(want) > 50


def test_text_output_keeps_whole_characters_and_columns(spark):
    rows = rows_of(11, 40)
    df = spark.createDataFrame([(i, t, "s", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, kept string, k int")
    found = remove_repeats(df, as_text=True)
    assert found.columns == ["doc_id", "text", "k", "n_bytes", "n_removed", "n_spans"]
    exact = {r.k: r for r in remove_repeats(df).collect()}
    for r in found.collect():
        assert len(r.text.encode()) == r.n_bytes - r.n_removed
        assert r.text == exact[r.k].kept.decode("utf-8", "ignore") or r.n_removed < exact[r.k].n_removed


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert remove_repeats(df).count() == 0


def test_query_against_brute_force(spark):
    where = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{where}/documents.parquet").collect()]
    found = sorted([tuple(r) for r in QUERIES["op10_repeats"](spark, where).collect()], key=str)
    assert found == brute(rows)
