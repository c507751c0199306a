"""Test passages in training documents, found with suffix arrays of the training side.

Documents are worked on in shards of some megabytes. A shard's words become ids of the test
vocabulary (0 for any other word), and the places of known words are sorted by the words that
follow them: the shard's suffix array, as deep as a window. Every test suffix is then
binary-searched in it; the places between the two bounds are all its verbatim occurrences.
From the places where hits begin, the longest match is followed word by word in the sorted
suffixes of the test side.

The test side is broadcast in blocks of ``BLOCK_BYTES`` of text each, so that no single
broadcast grows with it; each shard searches one block after the other.

Defined cases: null and empty texts have no words and no hits; an item without words is never
found; rows with the same item_id are one item; a null item_id is written ``null``; with an empty test table nothing is
hit; repeated document rows each get their result; input columns that have the name of a
result column are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fixatlas.llm.ragged import bounds_of, flat, gathered, lower_ascii, runs, slice_hashes, spread, utf8

BLOCK_BYTES = 4 << 20
WINDOW = 10
RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("longest_words", T.LongType()),
        T.StructField("longest_at", T.LongType()),
        T.StructField("longest_item", T.StringType()),
    ]
)

_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True


def words_of(data: np.ndarray, bounds: np.ndarray):
    """Lower-cased bytes, starts and ends of all words, and the bounds of the texts in words."""
    data = lower_ascii(data)
    starts, ends = runs(_IS_WORD[data], bounds)
    return data, starts, ends, np.searchsorted(starts, bounds)


class TestSide:
    """One block of test items: vocabulary, distinct windows, and sorted suffixes."""

    __test__ = False

    def __init__(self, items: list[tuple[str, str]], window: int):
        data, bounds = utf8(pa.array([t for _, t in items], pa.large_string()))
        data, starts, ends, by_item = words_of(data, bounds)
        self.names = np.array([name for name, _ in items], object)
        hashes = slice_hashes(data, starts, ends)
        self.vocabulary, first, ids = np.unique(hashes, return_index=True, return_inverse=True)
        self.words = [data[starts[i] : ends[i]].tobytes() for i in first]
        ids = ids.astype(np.int64) + 1
        lengths = np.diff(by_item)
        self.depth = window
        self.bits = max(1, int(len(self.vocabulary)).bit_length())
        # A window starts at every word that has enough words after it, or at a short item's first.
        owner = np.repeat(np.arange(len(items)), lengths)
        place = np.arange(len(ids)) - by_item[:-1][owner]
        left = lengths[owner] - place
        at = np.flatnonzero((left >= window) | (place == 0))
        size = np.minimum(left[at], window)
        # Every suffix is followed by zeros up to the depth; items don't run into each other.
        padded = np.zeros(len(ids) + len(items) * (window + 1) + window, np.int64)
        shift = owner * (window + 1)
        where = np.arange(len(ids)) + shift
        padded[where] = ids
        table = padded[where[at][:, None] + np.arange(window)] if len(at) else np.zeros((0, window), np.int64)
        table[np.arange(window) >= size[:, None]] = 0
        self.windows, which = np.unique(table, axis=0, return_inverse=True)
        which = which.reshape(-1)
        self.sizes = (self.windows > 0).sum(axis=1)
        # Windows that lie at one place only, and the window one word before them.
        before = np.full(len(ids) + 1, -1, np.int64)
        before[at + 1] = which
        self.earlier = np.full(len(self.windows), -1, np.int64)
        self.earlier[which] = np.where(place[at] > 0, before[at], -1)
        self.earlier[np.bincount(which, minlength=len(self.windows)) > 1] = -1
        order = np.argsort(which, kind="stable")
        pairs = np.unique(np.stack([which[order], owner[at][order]], axis=1), axis=0)
        self.item_bounds = np.searchsorted(pairs[:, 0], np.arange(len(self.windows) + 1))
        self.window_items = pairs[:, 1]
        # All test suffixes in order, for following matches further.
        self.stream, self.suffixes = padded, where[np.lexsort(keys_at(padded, where, window, self.bits)[::-1])] if len(ids) else where
        self.suffixes = _fully_sorted(padded, self.suffixes, window, self.bits)
        self.item_of = np.zeros(len(padded), np.int64)
        self.item_of[where] = owner


def _fully_sorted(stream: np.ndarray, order: np.ndarray, depth: int, bits: int) -> np.ndarray:
    """Suffixes sorted by ``depth`` words become sorted by all: groups double their depth."""
    if len(order) == 0:
        return order
    rank = np.zeros(len(stream) + 1, np.int64)
    keys = np.stack(keys_at(stream, order, depth, bits))
    new = np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0))
    while True:
        rank[order] = np.cumsum(new)
        if new.all():
            return order
        after = rank[np.minimum(order + depth, len(stream))]
        again = np.lexsort((after, rank[order]))
        order, after = order[again], after[again]
        old = rank[order]
        same = np.append(False, (old[1:] == old[:-1]) & (after[1:] == after[:-1]))
        if (~same).sum() == new.sum():  # equal to their ends
            return order
        new, depth = ~same, depth * 2


def keys_at(stream: np.ndarray, at: np.ndarray, depth: int, bits: int) -> list[np.ndarray]:
    """The next ``depth`` ids from each place as few 64-bit numbers, in the order of the words."""
    per_key = 64 // bits
    out = []
    for first in range(0, depth, per_key):
        key = np.zeros(len(at), np.uint64)
        for k in range(first, min(first + per_key, depth)):
            key = (key << np.uint64(bits)) | stream[at + k].astype(np.uint64)
        out.append(key)
    return out


def _before(keys: list[np.ndarray], at: np.ndarray, wanted: list[np.ndarray], or_equal: bool) -> np.ndarray:
    result = np.full(len(at), or_equal)
    for key, want in zip(reversed(keys), reversed(wanted)):
        have = key[at]
        result = (have < want) | ((have == want) & result)
    return result


def search(keys: list[np.ndarray], wanted: list[np.ndarray], right: bool) -> np.ndarray:
    """Binary search of many key tuples in sorted ones, all side by side."""
    n = len(keys[0])
    low, high = np.zeros(len(wanted[0]), np.int64), np.full(len(wanted[0]), n, np.int64)
    while (low < high).any():
        mid = np.minimum((low + high) >> 1, n - 1)
        go = _before(keys, mid, wanted, right) & (low < high)
        low, high = np.where(go, mid + 1, low), np.where(go | (low >= high), high, mid)
    return low


class Shard:
    """Texts as words; the words' hashes are computed once for all blocks of tests."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.data, self.starts, self.ends, self.by_text = words_of(data, bounds)
        self.hashes = slice_hashes(self.data, self.starts, self.ends)

    def ids(self, side: TestSide) -> np.ndarray:
        """Test ids of the words, with zeros after each text so that none runs into the next."""
        at = np.minimum(np.searchsorted(side.vocabulary, self.hashes), len(side.vocabulary) - 1)
        known = side.vocabulary[at] == self.hashes
        stream = np.zeros(len(self.hashes) + side.depth, np.int64)
        stream[: len(at)] = np.where(known, at + 1, 0)
        return stream

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def occurrences(shard: Shard, stream: np.ndarray, side: TestSide) -> tuple[np.ndarray, np.ndarray]:
    """All (place, window) at which a test window occurs, by the shard's suffix array."""
    places = np.flatnonzero(stream[: len(shard.hashes)])
    if not len(places) or not len(side.windows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys = keys_at(stream, places, side.depth, side.bits)
    order = np.lexsort(keys[::-1])
    suffixes, keys = places[order], [k[order] for k in keys]
    width, flat = side.windows.shape[1], side.windows.reshape(-1)
    rows = np.arange(len(side.windows)) * width
    low = search(keys, keys_at(flat, rows, side.depth, side.bits), right=False)
    full = np.where(side.windows > 0, side.windows, (1 << side.bits) - 1).reshape(-1)
    high = search(keys, keys_at(full, rows, side.depth, side.bits), right=True)
    found = spread(low, high - low)
    window = np.repeat(np.arange(len(rows)), high - low)
    at, size = suffixes[found], side.sizes[window]
    # A window must end inside its text.
    text = np.searchsorted(shard.by_text, at, "right") - 1
    inside = at + size <= shard.by_text[text + 1]
    at, window = at[inside], window[inside]
    # Equal hashes are not yet equal words: the words under hits are compared as bytes.
    sizes = side.sizes[window]
    used = np.unique(spread(at, sizes))
    wrong = [i for i in used.tolist() if shard.word(i) != side.words[stream[i] - 1]]
    if wrong:
        bad = np.isin(spread(at, sizes), wrong)
        good = ~np.add.reduceat(bad, bounds_of(sizes)[:-1]).astype(bool)
        at, window = at[good], window[good]
    return at, window


def longest_from(shard: Shard, stream: np.ndarray, side: TestSide, at: np.ndarray):
    """Length of the longest test passage that starts at each place, and where it lies."""
    text_end = shard.by_text[np.searchsorted(shard.by_text, at, "right")]
    low, high = np.zeros(len(at), np.int64), np.full(len(at), len(side.suffixes), np.int64)
    length = np.zeros(len(at), np.int64)
    live = np.arange(len(at))
    while len(live):
        live = live[at[live] + length[live] < text_end[live]]
        word = stream[at[live] + length[live]]
        live, word = live[word > 0], word[word > 0]
        below = _narrow(side, low[live], high[live], length[live], word, False)
        above = _narrow(side, low[live], high[live], length[live], word, True)
        go = above > below
        live = live[go]
        low[live], high[live] = below[go], above[go]
        length[live] += 1
    return length, side.item_of[side.suffixes[np.minimum(low, len(side.suffixes) - 1)]]


def _narrow(side: TestSide, low, high, depth, word, right: bool):
    low, high = low.copy(), high.copy()
    while (low < high).any():
        mid = np.minimum((low + high) >> 1, len(side.suffixes) - 1)
        have = side.stream[np.minimum(side.suffixes[mid] + depth, len(side.stream) - 1)]
        go = ((have <= word) if right else (have < word)) & (low < high)
        low, high = np.where(go, mid + 1, low), np.where(go | (low >= high), high, mid)
    return low


def search_texts(data: np.ndarray, bounds: np.ndarray, sides) -> pa.StructArray:
    """The result of every text against all blocks of tests, in the order of ``RESULT``."""
    shard, n = Shard(data, bounds), len(bounds) - 1
    hit = np.zeros(len(shard.hashes), bool)
    items: dict[int, set] = {}
    best = np.zeros(n, np.int64)
    best_at, best_item = np.zeros(n, np.int64), np.full(n, None, object)
    for side in sides:
        if not len(side.vocabulary) or not len(shard.hashes):
            continue
        stream = shard.ids(side)
        # Ids run on over the end of a text in this stream; ``occurrences`` looks at the ends.
        at, window = occurrences(shard, stream, side)
        if not len(at):
            continue
        hit[spread(at, side.sizes[window])] = True
        text = np.searchsorted(shard.by_text, at, "right") - 1
        for t, w in np.unique(np.stack([text, window], axis=1), axis=0).tolist():
            mine = side.window_items[side.item_bounds[w] : side.item_bounds[w + 1]]
            items.setdefault(t, set()).update(side.names[mine].tolist())
        # A place whose only match is the rest of the match one word before needs no look.
        full = np.full(len(hit) + 1, -2, np.int64)
        whole = side.sizes[window] == side.depth
        full[at[whole] + 1] = window[whole]
        rest = whole & (full[at] == side.earlier[window]) & ~np.isin(at, shard.by_text)
        begins = np.setdiff1d(at[whole], at[rest])
        length, item = longest_from(shard, stream, side, begins)
        # A short item is a window of its own and ends where it ends.
        begins = np.concatenate([begins, at[~whole]])
        length = np.concatenate([length, side.sizes[window[~whole]]])
        item = np.concatenate([item, side.window_items[side.item_bounds[window[~whole]]]])
        owner = np.searchsorted(shard.by_text, begins, "right") - 1
        for i in np.lexsort((begins, -length, owner)).tolist():
            t = owner[i]
            if length[i] > best[t]:
                best[t], best_at[t], best_item[t] = length[i], begins[i] - shard.by_text[t], side.names[item[i]]
    lists = [sorted(items.get(t, ())) for t in range(n)]
    hits = bounds_of(hit.astype(np.int64))[shard.by_text]
    none = best == 0
    return pa.StructArray.from_arrays(
        [
            pa.array(np.diff(shard.by_text), pa.int64()),
            pa.array(np.diff(hits), pa.int64()),
            pa.array(lists, pa.list_(pa.string())),
            pa.array(best, pa.int64()),
            pa.array(best_at, pa.int64(), mask=none),
            pa.array(best_item, pa.string()),
        ],
        [f.name for f in RESULT],
    )


def test_blocks(tests: DataFrame, window: int, block_bytes: int = BLOCK_BYTES) -> list:
    """Broadcasts of the test side, each of at most ``block_bytes`` of text or one item."""
    spark = tests.sparkSession
    rows = tests.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")), "text").where("length(text) > 0")
    out, held, size = [], [], 0
    for name, text in rows.toLocalIterator():
        if held and size + len(text) > block_bytes:
            out.append(spark.sparkContext.broadcast(TestSide(held, window)))
            held, size = [], 0
        held.append((name, text))
        size += len(text)
    if held:
        out.append(spark.sparkContext.broadcast(TestSide(held, window)))
    return out


test_blocks.__test__ = False


def overlaps(
    docs: DataFrame, tests: DataFrame, text: str = "text", window: int = WINDOW,
    keep: list[str] | None = None, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Each document's words, words hit, items that occur, and its longest verbatim match.

    ``keep`` names the columns that are passed through; all by default.
    """
    names = [f.name for f in RESULT]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in names]
    rows = docs.select(*dict.fromkeys([*kept, text]))
    schema = T.StructType([*(rows.schema[c] for c in kept), *RESULT])
    sides = test_blocks(tests, window, block_bytes)

    def run(batches):
        for table in gathered(batches, text):
            data, bounds = utf8(table.column(text))
            found = search_texts(data, bounds, (s.value for s in sides))
            own = [flat(table.column(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*own, *found.flatten()], [*kept, *names])

    return rows.mapInArrow(run, schema)


def decontaminate(docs: DataFrame, tests: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents in which no test window occurs, with the columns they had."""
    clash = {f.name for f in RESULT} & set(docs.columns)
    held = docs.select(*[F.col(c).alias(f"own_{c}" if c in clash else c) for c in docs.columns])
    clean = overlaps(held, tests, window=window).where("n_hit = 0")
    return clean.select(*[F.col(f"own_{c}" if c in clash else c).alias(c) for c in docs.columns])
