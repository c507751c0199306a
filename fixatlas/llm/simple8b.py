"""Token ids in 64-bit words that each hold as many ids as fit (Simple-8b).

A word's top 4 bits select how many ids of how many bits its other 60 bits hold. Ids over 60
bits go to a list of their own; an escape word holds the place in it. Words start anew in each
block of ``BLOCK`` ids, and the place of every block's first word is kept, so that blocks are
packed and unpacked side by side in whole-array steps, and any block alone.

Segment (little-endian): 8 bytes ``FXS8B001``; 64-bit counts of texts, ids, words, blocks and
escapes; then as arrays of 64 bits the bounds of the texts, the first word of each block,
the words, and the escaped ids.
"""

from __future__ import annotations

import numpy as np

from fixatlas.llm.ragged import bounds_of, spread

MAGIC = b"FXS8B001"
BLOCK = 128
# Fixed values of the format: ids in a word and bits of an id, by selector. The last escapes.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 1], np.int64)
WIDTHS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 60], np.int64)
ESCAPE = 14


def _bit_lengths(ids: np.ndarray) -> np.ndarray:
    bits = np.zeros(len(ids), np.uint8)
    rest = ids.copy()
    for step in (32, 16, 8, 4, 2, 1):
        high = rest >> np.uint64(step)
        has = high > 0
        bits[has] += step
        rest = np.where(has, high, rest)
    return bits + (rest > 0).view(np.uint8)


def _selectors(bits: np.ndarray) -> np.ndarray:
    """For a word that starts at each id: the selector that packs most ids, within its block."""
    n = len(bits)
    left = np.minimum(BLOCK - np.arange(n) % BLOCK, n - np.arange(n)).astype(np.uint8)
    best = np.full(n, ESCAPE, np.uint8)
    width, most = 1, bits
    for s in range(ESCAPE - 1, -1, -1):
        count = int(COUNTS[s])
        if count > n:
            break
        if count > width:  # the most bits among ``count`` ids in a row, from two shorter rows
            most = np.maximum(most[: n - count + 1], most[count - width : n - width + 1])
            width = count
        best[: n - count + 1][(most <= WIDTHS[s]) & (left[: n - count + 1] >= count)] = s
    return best


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, first word of each block, and escaped ids."""
    ids = np.ascontiguousarray(ids, np.uint64)
    n = len(ids)
    selector = _selectors(_bit_lengths(ids))
    # All blocks advance together, one word at a time.
    cursor = np.arange(0, n, BLOCK, dtype=np.int64)
    stop = np.minimum(cursor + BLOCK, n)
    n_blocks, block = len(cursor), np.arange(len(cursor))
    places, owners = [], []
    while len(cursor):
        places.append(cursor)
        owners.append(block)
        cursor = cursor + COUNTS[selector[cursor]]
        go = cursor < stop
        cursor, stop, block = cursor[go], stop[go], block[go]
    at = np.sort(np.concatenate(places)) if places else np.zeros(0, np.int64)
    sel = selector[at].astype(np.int64)
    words = sel.astype(np.uint64) << np.uint64(60)
    for s in range(ESCAPE):
        mine = np.flatnonzero(sel == s)
        for k in range(COUNTS[s] if len(mine) else 0):
            words[mine] |= ids[at[mine] + k] << np.uint64(WIDTHS[s] * k)
    mine = np.flatnonzero(sel == ESCAPE)
    escaped = ids[at[mine]]
    words[mine] |= np.arange(len(mine), dtype=np.uint64)
    in_block = np.bincount(np.concatenate(owners), minlength=n_blocks) if owners else np.zeros(0, np.int64)
    return words, bounds_of(in_block)[:-1], escaped


def unpack(words: np.ndarray, escaped: np.ndarray) -> np.ndarray:
    """All ids of whole blocks of words."""
    sel = (words >> np.uint64(60)).astype(np.int64)
    places = bounds_of(COUNTS[sel])
    out = np.empty(places[-1], np.uint64)
    for s in range(ESCAPE + 1):
        mine = np.flatnonzero(sel == s)
        if not len(mine):
            continue
        if s == ESCAPE:
            out[places[mine]] = escaped[(words[mine] & np.uint64((1 << 60) - 1)).astype(np.int64)]
            continue
        mask = np.uint64((1 << int(WIDTHS[s])) - 1)
        for k in range(COUNTS[s]):
            out[places[mine] + k] = (words[mine] >> np.uint64(WIDTHS[s] * k)) & mask
    return out


def to_segment(ids: np.ndarray, text_bounds: np.ndarray) -> bytes:
    words, firsts, escaped = pack(ids)
    head = np.array([len(text_bounds) - 1, len(ids), len(words), len(firsts), len(escaped)], "<i8")
    arrays = (head, text_bounds.astype("<i8"), firsts.astype("<i8"), words.astype("<u8"), escaped.astype("<u8"))
    return MAGIC + b"".join(x.tobytes() for x in arrays)


def _sections(segment: bytes):
    if segment[:8] != MAGIC:
        raise ValueError("not a segment of packed ids")
    texts, ids, words, blocks, escapes = np.frombuffer(segment, "<i8", 5, 8).tolist()
    at, out = 48, []
    for count, kind in ((texts + 1, "<i8"), (blocks, "<i8"), (words, "<u8"), (escapes, "<u8")):
        out.append(np.frombuffer(segment, kind, count, at))
        at += 8 * count
    if at != len(segment):
        raise ValueError("a segment of packed ids has been cut")
    return ids, *out


def from_segment(segment: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a segment and the bounds of its texts."""
    n, bounds, _, words, escaped = _sections(segment)
    ids = unpack(words, escaped)
    if len(ids) != n:
        raise ValueError("a segment of packed ids does not hold what it says")
    return ids, bounds


def read_text(segment: bytes, text: int) -> np.ndarray:
    """The ids of one text, from the blocks that hold it alone."""
    _, bounds, firsts, words, escaped = _sections(segment)
    start, end = int(bounds[text]), int(bounds[text + 1])
    if start == end:
        return np.zeros(0, np.uint64)
    low, high = start // BLOCK, (end - 1) // BLOCK + 1
    upto = firsts[high] if high < len(firsts) else len(words)
    return unpack(words[firsts[low] : upto], escaped)[start - low * BLOCK : end - low * BLOCK]


def joined(values: np.ndarray, bounds: np.ndarray, closing: int) -> tuple[np.ndarray, np.ndarray]:
    """Every text's ids with one more at its end, and the new bounds."""
    lengths = np.diff(bounds)
    after = bounds_of(lengths + 1)
    out = np.full(after[-1], closing, np.uint64)
    out[spread(after[:-1], lengths)] = values
    return out, after
