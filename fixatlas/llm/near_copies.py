"""Documents whose sets of word n-grams overlap, by a MinHash LSH forest and exact verification.

The similarity of two texts is the Jaccard similarity of their sets of five words in a row
(all its words for a shorter text); words are runs of digits, letters and non-ASCII
characters, A-Z as small letters. Sets are of 64-bit hashes of the words.

1. Texts with equal sets are one node; everything after works on nodes, which carry their number of rows.
2. Each node has a signature of ``DEEPEST`` labels in every tree of the forest, and a tree is the sorted list of
   its signatures, whose common prefixes are the nodes of a trie. The walk goes through sorted neighbours from whole
   signatures to shorter prefixes; at each length nodes of one prefix meet, and one of them goes on for all. Trees
   are shortened one after the other, only until a pair at the threshold meets in
   some tree with the target probability (`depths`), so some trees stop at longer prefixes than others. Sets of
   fewer than four are similar to equal sets only and are in no tree. Each task walks its own nodes first; only
   what is left is dealt out by prefix, so a prefix that very many nodes share is no task's burden.
3. Nodes that meet, directly or over others, are a candidate group (components of stars,
   not of all pairs).
4. Within a group all pairs are verified on the whole sets; large groups are cut into
   blocks, and every pair of blocks is a task's work of bounded size. Only the number of links of
   each node and a spanning forest of the links leave the task.

Every pair that meets is verified, and so is every other pair of a group; no link between
verified texts is lost, and nothing is capped.

Defined cases: texts without words (null, empty) link to nothing, each is its own class; rows
with equal sets link to each other, also repeated rows; a null doc_id takes part, its class has
the least id that is not null; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixatlas.llm.components import components
from fixatlas.llm.ragged import bounds_of, flat, gathered, mixed, slice_hashes, spread, utf8
from fixatlas.llm.stored import parts, stored
from fixatlas.llm.suffix_search import words_of

WORDS, THRESHOLD, TARGET = 5, 0.8, 0.99999
TREES, DEEPEST = 24, 8
BLOCK_NODES, BLOCK_BYTES = 2048, 16 << 20


def depths(threshold: float, trees: int = TREES, deepest: int = DEEPEST, target: float = TARGET) -> list[int]:
    """Length of the prefixes that meet in each tree: one tree after the other gives up a label until the
    forest as a whole finds a pair at the threshold with the target probability."""
    found = [deepest] * trees
    while found[-1] > 1 and 1 - np.prod([1 - threshold**d for d in found]) < target:
        found[found.index(max(found))] -= 1
    return found


def fewest(threshold: float) -> int:
    """The least size of a set that can be so similar to another one."""
    return int(np.ceil(threshold / (1 - threshold) - 1e-9)) if threshold < 1 else 2**31 - 1


def shingles(data: np.ndarray, bounds: np.ndarray, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of n words in a row of each text, and their bounds."""
    data, starts, ends, by_text = words_of(data, bounds)
    hashes = slice_hashes(data, starts, ends)
    counts = np.diff(by_text)
    made = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    owner = np.repeat(np.arange(len(counts)), made)
    at = spread(by_text[:-1], made)
    size = np.minimum(counts[owner], n)
    h = size.astype(np.uint64)
    padded = np.append(hashes, np.zeros(n, np.uint64))
    for k in range(n):
        word = np.where(k < size, padded[at + k], np.uint64(0)) if k else padded[at]
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + word)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.append(True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1]))[: len(h)]
    return h[new], np.searchsorted(owner[new], np.arange(len(counts) + 1))


def _node_ids(sets: np.ndarray, bounds: np.ndarray) -> list[bytes | None]:
    """128 bits for each set, from sums and products over its hashes; none for an empty set."""
    n = len(bounds) - 1
    full = np.flatnonzero(np.diff(bounds) > 0)
    out: list[bytes | None] = [None] * n
    if not len(full):
        return out
    first = bounds[:-1][full]
    a = np.add.reduceat(mixed(sets ^ np.uint64(0x1234567)), first)
    b = np.add.reduceat(mixed(sets * np.uint64(0xD6E8FEB86659FD93)), first)
    both = np.stack([mixed(a), mixed(b)], axis=1).astype(">u8").tobytes()
    for k, t in enumerate(full.tolist()):
        out[t] = both[16 * k : 16 * k + 16]
    return out


def signatures(sets: np.ndarray, bounds: np.ndarray, trees: int, seed: int = 11) -> np.ndarray:
    """For each full set and tree the ``DEEPEST`` labels of 16 bits, most significant byte first."""
    full = np.flatnonzero(np.diff(bounds) > 0)
    out = np.zeros((len(full), trees, DEEPEST), ">u2")
    if not len(full):
        return out
    rng = np.random.default_rng(seed)
    factors = rng.integers(1, 2**63, (trees, DEEPEST), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    offsets = rng.integers(0, 2**64 - 1, (trees, DEEPEST), dtype=np.uint64)
    # A few thousand hashes at a time stay in the processor's cache.
    ends = bounds[1:][full]
    low = 0
    while low < len(full):
        base = bounds[:-1][full[low]]
        high = max(low + 1, int(np.searchsorted(ends, base + 16_384, "right")))
        part = sets[base : ends[high - 1]]
        places = bounds[:-1][full[low:high]] - base
        for t in range(trees):
            for k in range(DEEPEST):
                least = np.minimum.reduceat((part ^ offsets[t, k]) * factors[t, k], places)
                out[low:high, t, k] = mixed(least) >> np.uint64(48)
        low = high
    return out


def walked(tree: np.ndarray, keys: np.ndarray, depth: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Walks tries from whole signatures to the prefixes where their trees stop.

    ``keys`` are two numbers of 64 bits for each signature. Gives the order of the rows in the tries, and in that
    order pairs of places that meet, each row with the one that goes on for it; and the places of those that are left.
    """
    order = np.lexsort((keys[:, 1], keys[:, 0], tree))
    stop = np.array(depth)[tree[order]]
    high, low, tree = keys[order, 0], keys[order, 1], tree[order]
    left, pairs = np.arange(len(order)), []
    for d in range(DEEPEST, min(depth) - 1, -1):
        bits = 16 * d
        high_mask = np.uint64(2**64 - 1 - (2 ** max(64 - bits, 0) - 1))
        low_mask = np.uint64(0 if bits <= 64 else 2**64 - 1 - (2 ** (128 - bits) - 1))
        h, m, t = high[left] & high_mask, low[left] & low_mask, tree[left]
        new = np.ones(len(left), bool)
        # A tree that has stopped joins no more.
        new[1:] = (h[1:] != h[:-1]) | (m[1:] != m[:-1]) | (t[1:] != t[:-1]) | (stop[left[1:]] > d)
        heads = left[np.flatnonzero(new)[np.cumsum(new) - 1]]
        pairs.append(np.stack([left[~new], heads[~new]]))
        left = left[new]
    return order, np.concatenate(pairs, axis=1), left


def _walk(depth: list[int], rows: int = 1 << 18):
    """Edges (u, v) of nodes that meet, and the rows left, as (u, null, tree, key).

    Works block by block; the row left of the last prefix of a block goes into the next block, so sorted
    partitions are walked as a whole.
    """

    def block(table: pa.Table, more: bool):
        table = table.combine_chunks()
        node, key = table.column("node").chunk(0), table.column("key").chunk(0)
        tree = table.column("tree").to_numpy()
        width = np.diff(np.frombuffer(key.buffers()[1], np.int32, len(key) + 1, 4 * key.offset))
        assert (width == 2 * DEEPEST).all()
        first = np.frombuffer(key.buffers()[1], np.int32, 1, 4 * key.offset)[0]
        keys = np.frombuffer(key.buffers()[2], ">u8", 2 * len(key), int(first)).reshape(-1, 2).astype(np.uint64)
        order, pairs, left = walked(tree, keys, depth)
        held = None
        if more and len(left):
            held, left = table.take(pa.array(order[left[-1:]])), left[:-1]
        u, v, left = order[pairs[0]], order[pairs[1]], order[left]
        nothing = pa.nulls(len(u), pa.int32()), pa.nulls(len(u), pa.binary())
        met = pa.RecordBatch.from_arrays([node.take(pa.array(u)), node.take(pa.array(v)), *nothing], _MET)
        rest = pa.RecordBatch.from_arrays(
            [node.take(pa.array(left)), pa.nulls(len(left), pa.binary()), pa.array(tree[left], pa.int32()), key.take(pa.array(left))],
            _MET,
        )
        return held, met, rest

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch]).select(["node", "tree", "key"])
            held = table if held is None else pa.concat_tables([held, table])
            if len(held) >= rows:
                held, met, rest = block(held, True)
                yield met
                yield rest
        if held is not None and len(held):
            yield from block(held, False)[1:]

    return run


_MET = ["u", "v", "tree", "key"]


def _signed(text: str, n: int, trees: int):
    def run(batches):
        for table in gathered(batches, text, 4 << 20):
            sets, bounds = shingles(*utf8(table.column(text)), n)
            nodes = _node_ids(sets, bounds)
            raw = signatures(sets, bounds, trees).tobytes()
            places = np.arange(0, len(raw) + 1, 2 * DEEPEST, dtype=np.int32)
            keys = pa.Array.from_buffers(pa.binary(), len(places) - 1, [None, pa.py_buffer(places.tobytes()), pa.py_buffer(raw)])
            has = np.array([x is not None for x in nodes])
            yield pa.RecordBatch.from_arrays(
                [
                    flat(table.column("doc_id")),
                    flat(table.column("text_hash")),
                    pa.array(nodes, pa.binary()),
                    pa.ListArray.from_arrays(pa.array((bounds_of(has.astype(np.int64)) * trees).astype(np.int32)), keys),
                    pa.array(np.diff(bounds), pa.int64()),
                ],
                ["doc_id", "text_hash", "node", "keys", "size"],
            )

    return run


def _sets(n: int):
    """The set of each text whose node is wanted."""

    def run(batches):
        for table in gathered(batches, "text", 4 << 20):
            sets, bounds = shingles(*utf8(table.column("text")), n)
            nodes, wanted = _node_ids(sets, bounds), table.column("node").to_pylist()
            take = [i for i, (a, b) in enumerate(zip(nodes, wanted)) if a == b]
            raw = sets.tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([wanted[i] for i in take], pa.binary()),
                    pa.array([raw[8 * bounds[i] : 8 * bounds[i + 1]] for i in take], pa.binary()),
                ],
                ["node", "hashes"],
            )

    return run


def linked(a: list[np.ndarray], b: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which sets of ``a`` and of ``b`` are at least that similar, as a matrix."""
    values, which = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    size_a, size_b = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    cut = size_a.sum()
    rows_a, rows_b = np.repeat(np.arange(len(a)), size_a), np.repeat(np.arange(len(b)), size_b)
    # Hashes that only one side has are in no intersection.
    in_a, in_b = np.bincount(which[:cut], minlength=len(values)), np.bincount(which[cut:], minlength=len(values))
    shared = (in_a > 0) & (in_b > 0)
    column = np.cumsum(shared) - 1
    common = np.zeros((len(a), len(b)), np.float32)
    sides = []
    for rows, ids in ((rows_a, which[:cut]), (rows_b, which[cut:])):
        keep = shared[ids]
        rows, ids = rows[keep], column[ids[keep]]
        order = np.argsort(ids, kind="stable")
        sides.append((rows[order], ids[order]))
    wide = 1024
    for low in range(0, int(shared.sum()), wide):
        dense = []
        for (rows, ids), height in zip(sides, common.shape):
            m = np.zeros((height, wide), np.float32)
            i, j = np.searchsorted(ids, [low, low + wide])
            m[rows[i:j], ids[i:j] - low] = 1
            dense.append(m)
        common += dense[0] @ dense[1].T
    union = size_a[:, None] + size_b[None, :] - common
    return common >= threshold * union - 1e-6


def _labels(links: np.ndarray) -> np.ndarray:
    """Least index of the component of each row of a symmetric matrix of links."""
    n = len(links)
    labels = np.arange(n)
    if not n:
        return labels
    while True:
        least = np.where(links, labels[None, :], n).min(axis=1)
        new = np.minimum(labels, least)
        new = new[new]
        if (new == labels).all():
            return labels
        labels = new


def _verified(threshold: float):
    """Reads cells one after the other: their links by node, and edges that span them."""

    def cell(rows: pa.Table):
        nodes, copies = rows.column("node").to_pylist(), rows.column("copies").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in rows.column("hashes").to_pylist()]
        first = rows.column("first").to_numpy()
        i, j = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
        if i == j:
            # A row that the join doubled counts once.
            _, own = np.unique(np.array(nodes, object), return_index=True)
            one = two = own
        else:
            one = np.unique(np.array(nodes, object)[first], return_index=True)[1]
            one = np.flatnonzero(first)[one]
            two = np.unique(np.array(nodes, object)[~first], return_index=True)[1]
            two = np.flatnonzero(~first)[two]
        if not len(one) or not len(two):  # a block that no node fell into
            return [], [], np.zeros(0, np.int64)
        found = linked([sets[k] for k in one], [sets[k] for k in two], threshold)
        if i == j:
            np.fill_diagonal(found, False)
            members, matrix, links = one, found, found @ copies[one]
        else:
            members = np.concatenate([one, two])
            matrix = np.zeros((len(members), len(members)), bool)
            matrix[: len(one), len(one) :] = found
            matrix[len(one) :, : len(one)] = found.T
            links = matrix @ copies[members]
        root = _labels(matrix)
        return [nodes[k] for k in members], [nodes[members[r]] for r in root], links

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            key = np.stack([held.column("group_no").to_numpy(), held.column("i").to_numpy(), held.column("j").to_numpy()])
            cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            if not len(cuts):
                continue
            yield from out(held, [0, *cuts.tolist()])
            held = held.slice(cuts[-1])
        if held is not None and len(held):
            yield from out(held, [0, len(held)])

    def out(table, cuts):
        node, root, links = [], [], []
        for a, b in zip(cuts, cuts[1:]):
            x, y, z = cell(table.slice(a, b - a).combine_chunks())
            node += x
            root += y
            links += z.tolist()
        yield pa.RecordBatch.from_arrays(
            [pa.array(node, pa.binary()), pa.array(root, pa.binary()), pa.array(links, pa.int64())], ["node", "root", "links"]
        )

    return run


def near_copies(
    docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, trees: int = TREES, target: float = TARGET,
    block_nodes: int = BLOCK_NODES, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row for each document: doc_id, text_hash, class_id (least doc_id of its class), n_links."""
    depth = depths(threshold, trees, target=target)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    signed = stored(
        rows.mapInArrow(_signed("text", words, trees), "doc_id long, text_hash long, node binary, keys array<binary>, size long"),
        "signatures",
    )
    nodes = stored(
        signed.where("node is not null").groupBy("node").agg(
            F.min("doc_id").alias("least"), F.count("*").alias("copies"),
            F.min(F.struct("doc_id", "text_hash")).alias("one"), F.any_value("keys").alias("keys"), F.any_value("size").alias("size"),
        ),
        "nodes",
    )
    n = parts(docs.sparkSession)
    met = "u binary, v binary, tree int, key binary"
    places = nodes.where(F.col("size") >= fewest(threshold)).select("node", F.posexplode("keys").alias("tree", "key"))
    near = stored(places.mapInArrow(_walk(depth), met), "tries")
    # What the tasks have left, by the prefix where its tree stops, in the order of the tries.
    left = near.where("v is null").select(F.col("u").alias("node"), "tree", "key")
    prefix = F.substring("key", F.lit(1), 2 * F.element_at(F.array(*map(F.lit, depth)), F.col("tree") + 1))
    sorted_tries = left.repartition(n, "tree", prefix).sortWithinPartitions("tree", "key")
    far = sorted_tries.mapInArrow(_walk(depth), met)
    stars = near.unionByName(far).where("v is not null").select("u", "v")
    groups = stored(components(stars), "groups")
    # The sets of the nodes that have company, each from one of its texts.
    wanted = nodes.join(groups, "node").select("node", "root", "copies", "one.doc_id", "one.text_hash")
    found = rows.alias("r").join(
        wanted.select("node", F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")),
        F.expr("doc_id <=> id and text_hash = hash"),
    ).select("node", "text")
    # Equal rows all meet their node; one set stays.
    sets = found.mapInArrow(_sets(words), "node binary, hashes binary").dropDuplicates(["node"])
    member = stored(sets.join(wanted.select("node", "root", "copies"), "node"), "sets")
    size = member.groupBy("root").agg(F.count("*").alias("n"), F.sum(F.length("hashes")).alias("bytes"))
    blocks = F.greatest(F.ceil(F.col("n") / block_nodes), F.ceil(F.col("bytes") / block_bytes)).cast("int")
    placed = (
        member.join(size.select("root", blocks.alias("blocks"), F.xxhash64("root").alias("group_no")), "root")
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "group_no", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
            (F.col("own") <= F.col("other")).alias("first"), "node", "copies", "hashes",
        )
    )
    cells = placed.repartition(n, "group_no", "i", "j").sortWithinPartitions("group_no", "i", "j", "first", "node")
    checked = stored(cells.mapInArrow(_verified(threshold), "node binary, root binary, links long"), "links")
    links = checked.groupBy("node").agg(F.sum("links").alias("links"))
    classes = components(checked.select(F.col("node").alias("u"), F.col("root").alias("v")))
    known = nodes.select("node", "least", "copies").join(links, "node", "left").join(classes, "node", "left")
    known = known.withColumn("root", F.coalesce("root", "node"))
    heads = known.groupBy("root").agg(F.min("least").alias("class_id"))
    result = known.join(heads, "root").select(
        "node", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    return signed.select("doc_id", "text_hash", "node").join(result, "node", "left").select(
        "doc_id", "text_hash",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The document with the least id (then text hash) of each class, with the columns it had.

    Texts without words have no class and stay.
    """
    found = near_copies(docs, **options)
    linked_ = found.where("n_links > 0")
    chosen = linked_.groupBy("class_id").agg(F.min(F.struct("doc_id", "text_hash")).alias("one")).select("one.*")
    gone = linked_.select("doc_id", "text_hash").distinct().join(
        chosen.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")), F.expr("doc_id <=> d and text_hash = h"), "left_anti"
    )
    hashed = docs.withColumn("_hash_", F.xxhash64("text"))
    names = gone.select(F.col("doc_id").alias("_doc_"), F.col("text_hash").alias("_gone_"))
    left = hashed.join(names, F.expr("doc_id <=> _doc_ and _hash_ = _gone_"), "left_anti")
    # Rows that are the chosen one more than once: one stays.
    several = chosen.select(F.col("doc_id").alias("_doc_"), F.col("text_hash").alias("_one_"))
    return _first_of_equal(left, several).drop("_hash_")


def _first_of_equal(left: DataFrame, several: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    same = F.expr("doc_id <=> _doc_ and _hash_ = _one_")
    # Only rows that may be several are numbered; the rest is not moved.
    order = Window.partitionBy("doc_id", "_hash_").orderBy(F.lit(0))
    one = left.join(several, same, "left_semi").withColumn("_n_", F.row_number().over(order)).where("_n_ = 1").drop("_n_")
    return left.join(several, same, "left_anti").unionByName(one)
