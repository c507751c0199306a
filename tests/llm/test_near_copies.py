import random
import re

import numpy as np
import pyarrow as pa
import pytest

from fixatlas.llm.components import components
from fixatlas.llm.near_copies import _walk, depths, fewest, keep_one, linked, near_copies, shingles, walked
from fixatlas.llm.queries import QUERIES
from fixatlas.llm.ragged import utf8

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text, n=5):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + n]) for i in range(max(len(words) - n + 1, 1))} if words else set()


def brute(rows, threshold=0.8):
    """(doc_id, class_id, n_links) of each row, by comparing all pairs."""
    sets, n = [grams(t) for _, t in rows], len(rows)
    root, links = list(range(n)), [0] * n

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if min(len(sets[i]), len(sets[j])) < threshold * max(len(sets[i]), len(sets[j])):
                continue
            both = len(sets[i] & sets[j])
            if both and both * 10 >= round(threshold * 10) * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i in range(n):
        if rows[i][0] is not None:
            least[find(i)] = min(least.get(find(i), 10**9), rows[i][0])
    return sorted([(rows[i][0], least.get(find(i)) if sets[i] else rows[i][0], links[i]) for i in range(n)], key=str)


def rows_of(seed):
    r = random.Random(seed)
    words = ["w%d" % i for i in range(400)] + ["É", "ñ1"]
    rows = []
    for g in range(12):
        base = r.choices(words, k=r.choice([3, 5, 6, 40, 80, 200]))
        for _ in range(r.choice([1, 2, 5, 12])):
            copy = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
                copy[r.randrange(len(copy))] = r.choice(words)
            text = r.choice([" ", "  ", ", "]).join(copy)
            rows.append((len(rows), text.upper() if r.random() < 0.2 else text))
    rows += [(500, None), (501, ""), (502, "!!"), (503, "one"), (504, "One!"), (505, "x " * 50_000), (506, "x " * 60_000)]
    rows += [rows[0], rows[0], (rows[1][0], "another text with the same id"), (None, rows[2][1]), (None, "a b c d e f"), (None, "A b c d e f")]
    return rows


@pytest.mark.parametrize("seed,options", [(1, {}), (2, {"block_nodes": 3}), (3, {"block_bytes": 2000}), (4, {"trees": 30, "block_nodes": 1})])
def test_against_all_pairs(spark, seed, options):
    rows = rows_of(seed)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, node int").repartition(5)
    found = sorted([(r.doc_id, r.class_id, r.n_links) for r in near_copies(df, **options).collect()], key=str)
    assert found == brute(rows)


def test_one_of_each_class_stays(spark):
    rows = rows_of(5)
    df = spark.createDataFrame([(*r, "own") for r in rows], "doc_id long, text string, class_id string").repartition(3)
    kept = keep_one(df)
    assert kept.columns == df.columns
    found = kept.collect()
    assert len({(r.doc_id, r.text) for r in found}) == len(found) and all(r.class_id == "own" for r in found)
    left = [(r.doc_id, r.text) for r in found]
    assert all(n == 0 for _, _, n in brute(left))
    # Every document that went had a link, and a document of its class is left.
    classes = {c for _, c, n in brute(rows) if n}
    assert len(left) == sum(n == 0 for _, _, n in brute(rows)) + len(classes)


def missed(found, similarity):
    return np.prod([1 - similarity**d for d in found])


def test_prefixes_are_shortened_to_the_target():
    found = depths(0.8)
    assert found == [4] * 16 + [5] * 8 and depths(0.99) == [8] * 24 and depths(0.1, 4) == [1] * 4
    longer = list(found)
    longer[15] += 1
    assert missed(found, 0.8) <= 1e-5 < missed(longer, 0.8)


def test_least_sizes():
    for threshold in (0.5, 0.8, 0.9):
        n = fewest(threshold)
        assert n / (n + 1) >= threshold - 1e-9 and (n - 1) / n < threshold - 1e-9


def test_walk_against_all_prefixes():
    rng = np.random.default_rng(5)
    depth = [4, 5, 8]
    labels = rng.integers(0, 2, (3000, 8))
    labels[rng.random(3000) < 0.4, :4] = 1  # a prefix that very many share
    tree = rng.integers(0, 3, 3000)
    keys = np.frombuffer(labels.astype(">u2").tobytes(), ">u8").reshape(-1, 2).astype(np.uint64)
    order, pairs, left = walked(tree, keys, depth)
    root = np.arange(3000)
    for u, v in order[pairs].T[::-1]:  # heads of shorter prefixes first
        root[u] = root[v]
    name = {(t, tuple(x[: depth[t]])): i for i, (t, x) in enumerate(zip(tree.tolist(), labels.tolist()))}
    want = [name[t, tuple(x[: depth[t]])] for t, x in zip(tree.tolist(), labels.tolist())]
    assert len(set(zip(root, want))) == len(set(root)) == len(set(want)) == len(left)
    assert sorted([*order[pairs[0]], *order[left]]) == list(range(3000))


def test_sorted_rows_are_walked_in_blocks_as_a_whole():
    rng = np.random.default_rng(6)
    depth = [4, 5]
    rows = sorted((int(t), x.astype(">u2").tobytes()) for t, x in zip(rng.integers(0, 2, 2000), rng.integers(0, 2, (2000, 8))))
    batches = [
        pa.RecordBatch.from_arrays(
            [pa.array([b"%d" % k for k in range(i, i + 50)], pa.binary()), pa.array([t for t, _ in rows[i : i + 50]], pa.int32()),
             pa.array([x for _, x in rows[i : i + 50]], pa.binary())], ["node", "tree", "key"])
        for i in range(0, 2000, 50)
    ]
    out = pa.Table.from_batches(list(_walk(depth, 120)(batches))).to_pylist()
    root = {r["u"]: r["v"] for r in out if r["v"] is not None}
    left = {r["u"]: (r["tree"], r["key"]) for r in out if r["v"] is None}

    def end(x):
        return end(root[x]) if x in root else x

    assert len(root) + len(left) == 2000 and len({(t, k[: 2 * depth[t]]) for t, k in left.values()}) == len(left)
    for k, (t, key) in enumerate(rows):
        t2, key2 = left[end(b"%d" % k)]
        assert t == t2 and key[: 2 * depth[t]] == key2[: 2 * depth[t]]


def test_sets_and_links_against_python():
    texts = [t for _, t in rows_of(6)]
    sets, bounds = shingles(*utf8(pa.array(texts)))
    mine = [sets[a:b] for a, b in zip(bounds, bounds[1:])]
    theirs = [grams(t) for t in texts]
    assert [len(x) for x in mine] == [len(x) for x in theirs]
    full = [i for i, x in enumerate(mine) if len(x)]
    got = linked([mine[i] for i in full], [mine[i] for i in full[:20]], 0.8)
    for i, a in enumerate(full):
        for j, b in enumerate(full[:20]):
            both = len(theirs[a] & theirs[b])
            assert got[i, j] == (both * 10 >= 8 * (len(theirs[a]) + len(theirs[b]) - both))


def test_components_against_union(spark):
    rng = np.random.default_rng(8)
    path = [(i, i + 1) for i in range(200)]
    pairs = path + [(1000, 1000 + i) for i in range(1, 300)] + [tuple(p) for p in rng.integers(2000, 2400, (200, 2)).tolist()] + [(5, 5), (3, 2)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a != b:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    rows = components(spark.createDataFrame(pairs, "u long, v long")).collect()
    assert len(rows) == len(root) and {r.node: r.root for r in rows} == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near_copies(df).count() == 0 and keep_one(df).count() == 0
    df = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert [tuple(r)[2:] for r in near_copies(df).collect()] == [(1, 0)]


def test_query_against_all_pairs(spark):
    where = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{where}/documents.parquet").collect()]
    assert sorted([tuple(r) for r in QUERIES["op4_near_copies"](spark, where).collect()], key=str) == brute(rows)


def test_many_equal_rows_are_one_node_with_one_set(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text)] * 20_000 + [(2, text + " w60"), (3, "other words of a text that no one has")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    found = near_copies(df).groupBy("doc_id", "class_id", "n_links").count().collect()
    assert sorted(tuple(r) for r in found) == [(1, 1, 20_000, 20_000), (2, 1, 20_000, 1), (3, 3, 0, 1)]
