"""Approximate nearest neighbours by inner product with an inverted multi-index.

Vectors are cut in two halves, each quantised by its own centroids; a cell is a pair of
centroids. A query walks the cells in the order of the summed inner products of its halves
with theirs, until the cells it has passed hold ``share`` of the entries, and of the distinct ids
other than its own (so many cells that one sort of their sums is cheaper than a heap over the two sorted
lists of centroids). The entries of those cells, and no others, are scored, a cell at a time for all queries of a
block that pass it, and the best are reranked by the inner product of the whole vectors in double precision. Rows of equal id and vector
are one entry; of the entries of one id the best counts, before anything is cut at rank ``k``.

Only the centroids come from a sample (``SAMPLE`` vectors at most, by the order of a hash);
every vector is an entry. The index is cut by a hash of the entry into shards, and the queries into blocks;
each task walks one shard's cells for one block of queries, and the best of all shards are merged.
Shards do not follow cells, so a cell that holds a third of all vectors lies in many shards.
``share`` is a share of what there is at any size: recall does not fall as the table grows.

Defined cases: vectors that are null, zero, of another length than most, or that hold null
or non-finite components take no part, nor do rows without id; rows that share an id count as
one neighbour, with the best score; equal scores go by the smaller id; if a query has fewer
than ``k`` candidates, all are returned; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fixatlas.llm.ragged import bounds_of, flat
from fixatlas.llm.stored import stored

SAMPLE = 20_000
CENTROIDS = 64
SHARD = 16_384
QUERY_BLOCK = 8_192
ROUNDS = 12
TOGETHER = 256  # queries that walk a shard at a time; their scores are a matrix of that many rows


def kmeans(points: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    distinct = np.unique(points, axis=0)
    centres = distinct[rng.choice(len(distinct), min(k, len(distinct)), replace=False)]
    for _ in range(rounds):
        own = nearest_centre(points, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        counts = np.bincount(own, minlength=len(centres))
        used = counts > 0
        centres = centres.copy()
        centres[used] = sums[used] / counts[used, None]
    return centres


def nearest_centre(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(axis=1) - 2 * points @ centres.T, axis=1)


def walks(
    first: np.ndarray, second: np.ndarray, cells: np.ndarray, counts: np.ndarray, enough: np.ndarray, rows: np.ndarray,
    shared: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.int64), np.zeros(0, np.int64)),
) -> tuple[np.ndarray, np.ndarray]:
    """Each query's places in ``cells`` by falling sum of the two halves' scores, and how many of them it passes.

    It passes cells until they hold ``enough`` distinct ids and ``rows`` entries. ``counts`` are the entries of the
    ``cells``, none of them empty; ``shared`` are the places of the cells of all entries whose id others have
    too, sorted by id, and where each id begins there.
    """
    i, j = np.divmod(cells, second.shape[1])
    order = np.argsort(-(first[:, i] + second[:, j]), axis=1, kind="stable")
    held = np.cumsum(counts[order], axis=1)
    ids = held
    at, begins = shared
    if len(at):
        ids = np.cumsum((counts - np.bincount(at, minlength=len(cells)))[order], axis=1)
        rank = np.empty(len(cells), np.int64)
        for q in range(len(order)):
            rank[order[q]] = np.arange(len(cells))
            # An id counts in the first of its cells that is passed.
            ids[q] += np.cumsum(np.bincount(np.minimum.reduceat(rank[at], begins), minlength=len(cells)))
    short = (ids < enough[:, None]) | (held < rows[:, None])
    return order, np.minimum(short.sum(axis=1) + 1, len(cells))


def walk(first: np.ndarray, second: np.ndarray, counts: np.ndarray, enough: int) -> list[int]:
    """The cells that one query passes; ``counts`` are those of all pairs of centroids."""
    cells = np.flatnonzero(counts)
    order, passed = walks(first[None], second[None], cells, counts[cells], np.array([enough]), np.array([0]))
    return cells[order[0, : passed[0]]].tolist()


def _matrix(column) -> np.ndarray:
    """Rows of equal length as a matrix."""
    column = flat(column)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return rows.where(F.col("id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The best ``k`` by falling score, then smaller id, of one entry for each id."""
    order = np.lexsort((ids, -scores))
    first = np.sort(np.unique(ids[order], return_index=True)[1])
    return order[first[:k]]


def _shared(ids: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the entries whose id another entry has too, sorted by id, the places of their cells; where each id begins."""
    _, which, times = np.unique(ids, return_inverse=True, return_counts=True)
    at = np.flatnonzero(times[which] > 1)
    at = at[np.argsort(which[at], kind="stable")]
    return places[at], np.flatnonzero(np.diff(which[at], prepend=-1))


def _cut(rough: np.ndarray, ids: np.ndarray, k: int) -> float:
    """A score that entries of ``k`` distinct ids reach, of all there are if they are fewer."""
    n = k
    while n < len(rough):
        cut = np.partition(rough, len(rough) - n)[len(rough) - n]
        if len(np.unique(ids[rough >= cut])) >= k:
            return cut
        n *= 2
    return -np.inf


def search_shard(x, ids, cells, q, query_ids, centres, share: float, k: int):
    """The best ``k`` entries that each query finds in one shard: (query, id, score)."""
    if not len(q) or not len(x):
        return [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    half, n_second = len(centres[0][0]), len(centres[1])
    order = np.argsort(cells, kind="stable")
    x, ids = x[order], ids[order]
    cells, places, counts = np.unique(cells[order], return_inverse=True, return_counts=True)
    ends = bounds_of(counts).tolist()
    distinct, times = np.unique(ids, return_counts=True)
    shared = _shared(ids, places)
    # Both are counted without the query's own rows, which may be among what is passed.
    own = np.append(times, 0)[np.where(np.isin(query_ids, distinct), np.searchsorted(distinct, query_ids), len(distinct))]
    others = len(distinct) - (own > 0)
    # Fewer ids than this can't be a result of ``k``.
    enough = np.maximum(np.ceil(share * others).astype(np.int64), np.minimum(others, 2 * k)) + (own > 0)
    rows = np.ceil(share * (len(x) - own)).astype(np.int64) + own
    out = []
    for low in range(0, len(q), TOGETHER):
        part, asking = q[low : low + TOGETHER], query_ids[low : low + TOGETHER]
        walked, n_passed = walks(
            part[:, :half] @ centres[0].T, part[:, half:] @ centres[1].T, cells, counts,
            enough[low : low + TOGETHER], rows[low : low + TOGETHER], shared,
        )
        passed = np.zeros((len(cells), len(part)), bool)
        for i, n in enumerate(n_passed.tolist()):
            passed[walked[i, :n], i] = True
        # Cell by cell: one product of its entries with the queries that pass it.
        scores = np.full((len(part), len(x)), -np.inf)
        for cell, (a, b) in enumerate(zip(ends, ends[1:])):
            those = np.flatnonzero(passed[cell])
            scores[those, a:b] = part[those] @ x[a:b].T
        for i, query in enumerate(asking.tolist()):
            take = np.flatnonzero(passed[places, i] & (ids != query))
            rough = scores[i, take]
            if len(take) > 4 * k:  # rounding of the product can't cost one of the best
                cut = _cut(rough, ids[take], k)
                take = take[rough >= cut - 1e-9 * (1 + abs(cut))] if np.isfinite(cut) else take
            # Summed in the same way for every pair, so equal vectors have equal scores.
            exact = (x[take] * part[i]).sum(axis=1)
            best = _best(exact, ids[take], k)
            out.append((np.full(len(best), query), ids[take][best], exact[best]))
    return [np.concatenate(c) for c in zip(*out)]


def nearest(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 20, k: int = 20,
    share: float = 0.5, centroids: int = CENTROIDS, shard: int = SHARD, query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of every row whose id ``every`` divides."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    usable = _usable(vectors, key, vector)
    asks = F.col("id") % every == 0
    sizes = usable.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.count_if(asks).alias("asking"))
    most = sizes.orderBy(F.desc("n"), "d").first()
    if most is None or not most.asking:
        return spark.createDataFrame([], schema)
    dim = most.d
    usable = usable.where(F.size("v") == dim).dropDuplicates(["id", "v"])
    half = dim // 2
    sampled = usable.withColumn("h", F.xxhash64("id"))
    # With many vectors only those with a small hash come to the sort, a few more than are taken.
    bound = 1.1 * SAMPLE / most.n
    if bound < 1:
        sampled = sampled.where(F.col("h") < F.lit((int(bound * (1 << 32)) << 32) - (1 << 63)))
    sampled = sampled.orderBy("h", "id").limit(SAMPLE).select("v").toArrow()
    points = _matrix(sampled.column("v"))
    centres = [kmeans(points[:, :half], centroids), kmeans(points[:, half:], centroids)]
    n_second = len(centres[1])

    def assign(batches):
        for batch in batches:
            x = _matrix(batch.column("v"))
            if len(x):
                cell = nearest_centre(x[:, :half], centres[0]) * n_second + nearest_centre(x[:, half:], centres[1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("v"), pa.array(cell, pa.int32())], ["id", "v", "cell"]
                )

    index = stored(usable.mapInArrow(assign, "id long, v array<double>, cell int"), "multi-index")
    held = index.agg(F.count("*").alias("n"), F.count_if(asks).alias("asking")).first()
    shards, blocks = -(-held.n // shard), -(-held.asking // query_block)
    part = lambda n: F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    entries = index.select(part(shards).alias("shard"), each(blocks).alias("block"), "id", "v", "cell")
    asking = index.where(asks).select(
        each(shards).alias("shard"), part(blocks).alias("block"), "id", "v"
    )

    def run(entries: pa.Table, asking: pa.Table) -> pa.Table:
        found = search_shard(
            _matrix(entries.column("v")), entries.column("id").to_numpy(), entries.column("cell").to_numpy(),
            _matrix(asking.column("v")), asking.column("id").to_numpy(), centres, share, k,
        )
        return pa.table([pa.array(f) for f in found], ["query_id", "vec_id", "score"])

    found = (
        entries.groupBy("shard", "block").cogroup(asking.groupBy("shard", "block"))
        .applyInArrow(run, "query_id long, vec_id long, score double")
    )
    one = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return one.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score").where(f"rank <= {k}")
