import cProfile

import numpy as np
import pytest

from fixatlas.llm.multi_index import _shared, kmeans, nearest, nearest_centre, search_shard, walk, walks
from fixatlas.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, rank int, score string"


def brute(ids, x, every, k):
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        score = (x * x[i]).sum(axis=1)
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), score[j]) for j in order]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert all([x[0] for x in v] == list(range(1, len(v) + 1)) for v in out.values())
    return {q: [x[1:] for x in v] for q, v in out.items()}


def test_cells_are_walked_by_falling_sum():
    rng = np.random.default_rng(1)
    a, b, counts = rng.normal(size=7), rng.normal(size=5), rng.integers(0, 3, 35)
    cells = walk(a, b, counts, 10**9)
    sums = (a[:, None] + b[None, :]).reshape(-1)
    assert cells == [c for c in np.argsort(-sums, kind="stable") if counts[c]]
    assert counts[walk(a, b, counts, 9)].sum() >= 9


@pytest.mark.parametrize("shard,block", [(10_000, 1000), (37, 5)])
def test_all_cells_give_the_exact_answer(spark, shard, block):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 7)).astype(np.float32)
    x[200:260] = x[3]  # a hot vector
    x[260:280] = x[20]
    ids = rng.permutation(300)
    df = spark.createDataFrame([(int(i), v.tolist(), 1, "x") for i, v in zip(ids, x)], SCHEMA).repartition(4)
    got = found(nearest(df, every=20, k=20, share=1.0, centroids=4, shard=shard, query_block=block))
    assert got == brute(ids, x.astype(np.float64), 20, 20)


def test_unusable_vectors_repeats_and_few_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (20, [2.0, 1.0]), (1, [3.0, 3.0]), (1, [1.0, 1.0]), (2, None), (40, [0.0, 0.0]), (3, [nan, 1.0]),
            (4, [inf, 1.0]), (5, [None, 1.0]), (6, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (60, [])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    assert found(nearest(df)) == {0: [(1, 9.0), (20, 4.0)], 20: [(1, 9.0), (0, 4.0)]}
    assert nearest(df.where("vec_id = 2")).count() == 0
    assert nearest(df.where("vec_id is null")).columns == ["query_id", "rank", "vec_id", "score"]
    assert found(nearest(df.where("vec_id = 20"))) == {}


@pytest.mark.parametrize("shard", [10_000, 40])
def test_repeated_rows_cost_no_neighbours(spark, shard):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 6)).astype(np.float32)
    ids = np.arange(200)
    near = int(np.argmax([(x[i] * x[0]).sum() if i else -9 for i in ids]))
    # Every row twice; the query's own and its nearest row often; one id with many near vectors of its own.
    rows = [(int(i), x[i].tolist()) for i in ids] * 2 + [(0, x[0].tolist()), (near, x[near].tolist())] * 90
    rows += [(7, (x[0] * (5 + s / 100)).tolist()) for s in range(120)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(4)
    whole = found(nearest(df, every=200, share=1.0, centroids=4, shard=shard))
    best = {}
    for i, v in rows:
        if i != 0:
            best[i] = max(best.get(i, -np.inf), float((np.array(v, np.float32).astype(np.float64) * x[0]).sum()))
    assert [i for i, _ in whole[0]] == sorted(best, key=lambda i: (-best[i], i))[:20]
    assert len(found(nearest(df, every=200, share=0.01, centroids=4, shard=shard))[0]) == 20


def test_query_recall(spark):
    where = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{where}/embeddings.parquet").toPandas()
    x, ids = np.array(rows.embedding.tolist(), np.float64), rows.vec_id.to_numpy()
    want, got = brute(ids, x, 20, 20), found(QUERIES["op8_multi_index"](spark, where))
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / (20 * len(want)) >= 0.9
    exact = {(q, i): s for q, v in brute(ids, x, 20, len(ids)).items() for i, s in v}
    assert all(s == exact[q, i] for q, v in got.items() for i, s in v)


def test_search_takes_few_calls_a_query():
    # A heap takes calls for each cell of each query: they made most of the time and grew with the square of the table.
    rng = np.random.default_rng(5)
    x, ids = rng.normal(size=(4000, 16)), np.arange(4000) // 3 * 2
    centres = [kmeans(x[:, :8], 32), kmeans(x[:, 8:], 32)]
    cells = nearest_centre(x[:, :8], centres[0]) * 32 + nearest_centre(x[:, 8:], centres[1])
    seen = cProfile.Profile()
    found = seen.runcall(search_shard, x, ids, cells, x[:900:3], ids[:900:3], centres, 1.0, 5)
    assert sum(e.callcount for e in seen.getstats()) < 300 * 300
    for query in (0, 200, 598):
        scores = (x * x[query // 2 * 3]).sum(axis=1)
        best = {i: scores[ids == i].max() for i in set(ids.tolist()) - {query}}
        assert found[1][found[0] == query].tolist() == sorted(best, key=lambda i: (-best[i], i))[:5]


def test_an_id_counts_once_however_many_cells_it_lies_in():
    rng = np.random.default_rng(6)
    first, second, ids = rng.normal(size=(9, 4)), rng.normal(size=(9, 3)), rng.integers(0, 20, 60)
    cells, places, counts = np.unique(rng.integers(0, 12, 60), return_inverse=True, return_counts=True)
    order, passed = walks(first, second, cells, counts, np.full(9, 11), np.full(9, 17), _shared(ids, places))
    for q in range(9):
        met = [np.isin(places, order[q, :n]) for n in (passed[q] - 1, passed[q])]
        assert [len(set(ids[m].tolist())) >= 11 and m.sum() >= 17 for m in met] == [False, True]
