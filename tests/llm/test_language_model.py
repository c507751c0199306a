import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from fixatlas.llm import attention
from fixatlas.llm.language_model import ROUNDS, language_scores, training_windows
from fixatlas.llm.queries import QUERIES, tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PATH = tokenizer_path("byte_bpe_multi_50k.tiktoken")


def plain(rows):
    """Everything but the model's score, by plain counting."""
    words = [WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None] for _, t in rows]
    out_of = [zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0 for i, _ in rows]
    c = Counter(w for ws, h in zip(words, out_of) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    return [
        (i, h, len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws))
        for (i, _), ws, h in zip(rows, words, out_of)
    ]


def check(found, rows):
    key = lambda r: (str(r[0]), *map(str, r[1:5]))
    want, got = sorted(plain(rows), key=key), sorted([tuple(r)[:6] for r in found], key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-6 * max(1, abs(b[5]))
    assert all(r.score < 0 and math.isfinite(r.score) for r in found)


def test_counts_on_hard_texts(spark):
    texts = [None, "", " ", "\n\t", "A a\x0bB", "é É", "x" * 3000, "the cat sat " * 3000, "nbsp stays one", "\x00 \x1f"]
    rows = [(i, t) for i, t in enumerate(texts * 3)] + [(None, "a"), (None, "a"), (7, "a b"), (7, "a b")]
    df = spark.createDataFrame([(*r, 0.0) for r in rows], "doc_id long, text string, score double").repartition(3)
    check(language_scores(df, PATH).collect(), rows)


def test_empty_table_and_no_learning_documents(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert language_scores(df, PATH).count() == 0
    out = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    rows = [(out, "some text"), (out, None)]
    found = language_scores(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()
    assert {(r.n_known, r.train_tokens) for r in found} == {(0, 0)} and all(r.score < 0 for r in found)


def small(groups=4, members=5, window=8):
    rng = np.random.default_rng(1)
    n = groups * members
    return attention.start(rng.random((n, n)) * 20, width=6, window=window), rng, n


@pytest.fixture
def few_groups(monkeypatch):
    monkeypatch.setattr(attention, "GROUPS", 4)


def test_probabilities_sum_to_one_and_look_back_only(few_groups):
    p, rng, n = small()
    ids = rng.integers(0, n, (1, 8))
    h, _ = attention.hidden(p, ids)
    total = np.exp(attention.output(p, np.repeat(h[0, 3:4], n, 0), np.full(n, ids[0, 3]), np.arange(n))[0]).sum()
    assert abs(total - 1) < 1e-5
    other = ids.copy()
    other[0, 5:] = (other[0, 5:] + 1) % n
    assert np.array_equal(attention.hidden(p, other)[0][0, :5], h[0, :5])


def test_gradients_are_the_slopes(few_groups):
    p, rng, n = small()
    p = {k: v.astype(np.float64) for k, v in p.items()}
    ids, target, counts = rng.integers(0, n, (3, 8)), rng.integers(0, n, (3, 8)), rng.random((3, 8)) > 0.2
    _, g = attention.loss_and_gradients(p, ids, target, counts)
    assert set(g) == set(p) - set(attention.FIXED)
    for k in g:
        d = rng.normal(size=p[k].shape)
        up, down = ({**p, k: p[k] + s * 1e-4 * d} for s in (1, -1))
        slope = (attention.loss_and_gradients(up, ids, target, counts)[0] - attention.loss_and_gradients(down, ids, target, counts)[0]) / 2e-4
        assert abs(slope - (g[k] * d).sum()) < 1e-5 * max(1, abs(slope))


@pytest.mark.parametrize("scale", [1, 400])
def test_each_class_is_scored_once_in_its_window(few_groups, scale):
    p, rng, n = small()
    p["out"] *= scale  # beyond the range of plain exponentials
    classes, bounds = rng.integers(0, n, 120), np.array([0, 0, 3, 40, 41, 120])
    got = attention.log_probabilities(p, classes, bounds, 2, stride=6)
    for t in range(5):
        line = np.append(2, classes[bounds[t] : bounds[t + 1]])
        for i in range(len(line) - 1):
            first = 0 if i < 8 else ((i - 8) // 6 + 1) * 6
            h, _ = attention.hidden(p, line[None, first : i + 1])
            want, _, _ = attention.output(p, h[0, -1:], line[i : i + 1], line[i + 1 : i + 2])
            assert abs(got[bounds[t] + i] - want[0]) < 1e-3 * max(1, abs(want[0]))


def test_windows_tile_every_text():
    sizes = np.array([1, 33, 34, 2, 65, 2000])  # with the beginning
    bounds = np.append(0, np.cumsum(sizes))
    line = np.arange(bounds[-1])
    windows = np.concatenate([training_windows(line, bounds, r) for r in range(ROUNDS)])
    assert sorted(windows[:, 1:][windows[:, 1:] >= 0].tolist()) == sorted(set(line.tolist()) - set(bounds[:-1].tolist()))
    assert all((np.diff(w[w >= 0]) == 1).all() for w in windows)


def test_query_counts_and_beats_word_counts(spark):
    where = "/root/testdata/sf0.1"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{where}/documents.parquet").collect()]
    found = QUERIES["op2_language_model"](spark, where).collect()
    check(found, rows)
    out = [r for r in found if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
