import random
import re
from collections import Counter

import numpy as np
import pytest
from compare import agrees

from fixatlas.llm import phrases as ph
from fixatlas.llm.queries import EXPECTED, QUERIES


def slow(rows, least=100, percent=100, shown=2000):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang, text = lang or "und", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, 6):
                counts.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    cands = {key: a for key, a in counts.items() if len(key[1]) > 1 and a >= least}
    out = []
    for (lang, w), a in cands.items():
        n = totals[lang]
        cuts = []
        for k in range(1, len(w)):
            l, r = counts[lang, w[:k]], counts[lang, w[k:]]
            cuts.append((1000 * a * n // (l * r), k, l, r))
        score, _, l, r = min(cuts)
        longer = [b for (m, v), b in cands.items() if m == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v)))]
        if not any(100 * b >= percent * a for b in longer):
            out.append((lang, -score, -a, " ".join(w).encode(), l, r, n))
    ranked, seen = [], Counter()
    for lang, score, a, phrase, l, r, n in sorted(out):
        seen[lang] += 1
        if seen[lang] <= shown:
            ranked.append((lang, seen[lang], phrase.decode(), -a, l, r, n, -score))
    return sorted(ranked)


def fast(df, **options):
    return sorted(tuple(r) for r in ph.collocations(df, **options).collect())


def corpus(seed, n):
    r = random.Random(seed)
    vocab = ["the", "The", "of", "é", "ß", "a", "b", "c", "q\x00", "x-y", "…"]
    gaps = [" ", " ", "  ", "\t", " \t ", ".", ", ", "\n", "\x0b", "!", "? ", ";", ":"]
    rows = []
    for _ in range(n):
        words = r.choices(vocab, k=r.randint(0, 40))
        rows.append((r.choice(["en", "en", "en", None, "und", "é"]), "".join(w + r.choice(gaps) for w in words)))
    return rows


@pytest.mark.parametrize("seed, options", [(1, {"least": 6}), (2, {"least": 11}), (3, {"least": 6, "percent": 60, "shown": 15})])
def test_random_corpus_against_brute_force(spark, seed, options):
    rows = corpus(seed, 300) + [(None, None), ("en", ""), ("en", " \t"), ("fr", "...")]
    df = spark.createDataFrame([(*x, 1, "r") for x in rows], "lang string, text string, n int, phrase string").repartition(13)
    want = slow(rows, **options)
    assert want and fast(df, **options) == want


def test_a_shard_may_hold_all_of_a_phrase(spark):
    rows = [("en", f"w{i} v{i} u{i}") for i in range(500)] + [("en", "one of many one of many")] * 60
    df = spark.createDataFrame(rows, "lang string, text string").coalesce(3)
    assert fast(df, least=100) == slow(rows)


def test_blocks_and_buckets_change_nothing(spark, monkeypatch):
    rows = corpus(4, 200)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    monkeypatch.setattr(ph, "BLOCK", 200)
    monkeypatch.setattr(ph, "HELD", 500)
    monkeypatch.setattr(ph, "BUCKET_BYTES", 300)
    assert fast(df, least=10) == slow(rows, least=10)


def test_full_maps_only_add_work(spark, monkeypatch):
    rows = corpus(5, 200)
    monkeypatch.setattr(ph, "in_map", lambda bits, h: np.ones(len(h), bool))
    df = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    assert fast(df, least=10) == slow(rows, least=10)


def test_scores_beyond_64_bits(spark):
    big = 4 * 10**15
    counts = spark.createDataFrame(
        [("en", "", 0, big), ("en", "a", 1, 3 * 10**9 + 1), ("en", "b", 1, 7 * 10**8), ("en", "a b", 2, 6 * 10**8 + 7)],
        "lang string, phrase string, k int, n long",
    )
    row = ph.scored(counts).first()
    assert row.score == 1000 * (6 * 10**8 + 7) * big // ((3 * 10**9 + 1) * 7 * 10**8)


def test_empty_table_and_hot_text(spark):
    assert fast(spark.createDataFrame([], "lang string, text string")) == []
    rows = [("en", "very much the same text")] * 3000 + [("en", f"x{i} y") for i in range(300)]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(9)
    assert fast(df) == slow(rows)


def test_packing():
    h = np.array([0, 1, (1 << 40) - 1, 12345678901], np.uint64)
    assert ph.unpack(ph.pack(h)).tolist() == h.tolist()


def test_query_against_sql(spark):
    agrees(spark, QUERIES["op11_phrases"], EXPECTED["op11_phrases"], "/root/testdata/sf0.01")
