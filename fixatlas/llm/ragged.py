"""Texts and lists as flat arrays with bounds, so that tasks work on whole blocks at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 8 << 20
BLOCK_ROWS = 1 << 16


def bounded(batches, column: str, limit: int = BLOCK_BYTES, rows: int = BLOCK_ROWS):
    """Record batches cut so that each holds at most ``limit`` bytes of ``column`` and ``rows`` rows.

    A single value over the limit makes a batch of its own; no value is cut.
    """
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        ends = np.cumsum(np.asarray(sizes).astype(np.int64))
        first = 0
        while first < batch.num_rows:
            base = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, base + limit, "right")))
            last = min(last, first + rows)
            yield batch.slice(first, last - first)
            first = last


def gathered(batches, column: str, limit: int = BLOCK_BYTES, rows: int = BLOCK_ROWS):
    """Tables of about ``limit`` bytes of ``column``, of ``rows`` rows at most: small batches put together, large ones cut."""
    held, size, count = [], 0, 0
    for batch in bounded(batches, column, limit, rows):
        n = batch.column(column).nbytes
        if held and (size + n > limit or count + batch.num_rows > rows):
            yield pa.Table.from_batches(held).combine_chunks()
            held, size, count = [], 0, 0
        held.append(batch)
        size += n
        count += batch.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def flat(array: pa.Array) -> pa.Array:
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks() if array.num_chunks != 1 else array.chunk(0)
    return array


def utf8(array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after the other, and the n + 1 bounds; null is empty."""
    array = flat(array)
    if array.null_count:
        array = pc.fill_null(array, b"" if pa.types.is_binary(array.type) else "")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, places, body = array.buffers()
    if len(array) == 0 or places is None:
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    bounds = np.frombuffer(places, np.int64 if wide else np.int32)
    bounds = bounds[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def strings(data: np.ndarray, bounds: np.ndarray, kind=pa.large_binary()) -> pa.Array:
    """The slices of ``data`` between neighbouring bounds, without copying the bytes."""
    data = np.ascontiguousarray(data)
    return pa.Array.from_buffers(
        kind, len(bounds) - 1, [None, pa.py_buffer(np.ascontiguousarray(bounds, np.int64)), pa.py_buffer(data)]
    )


def bounds_of(lengths: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of all slices, one after the other."""
    ends = bounds_of(lengths)
    out = np.arange(ends[-1], dtype=np.int64)
    out += np.repeat(starts - ends[:-1], lengths)
    return out


def lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values."""
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values, kind))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z in small letters, all other bytes as they are."""
    return data + (((data >= 65) & (data <= 90)).view(np.uint8) << 5)


def runs(member: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true bytes; runs end where a text ends."""
    n = len(member)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    opens, closes = member.copy(), member.copy()
    opens[1:] &= ~member[:-1]
    closes[:-1] &= ~member[1:]
    cuts = bounds[(bounds > 0) & (bounds < n)]
    opens[cuts] = member[cuts]
    closes[cuts - 1] = member[cuts - 1]
    return np.flatnonzero(opens), np.flatnonzero(closes) + 1


_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose low and high bits all depend on all bits."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    np.multiply.accumulate(out, out=out)
    return out


def slice_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """A 64-bit hash of each slice of bytes, equal for equal slices wherever they lie.

    Sums of byte times power of an odd base, modulo 2**64, taken from running totals; the
    shift by the slice's place is undone with the inverse of the base. The slices are in order
    and don't overlap; about a megabyte is worked on at a time.
    """
    out = np.empty(len(starts), np.uint64)
    weights = back = np.zeros(0, np.uint64)
    first = 0
    while first < len(starts):
        low = starts[first]
        last = max(first + 1, int(np.searchsorted(ends, low + (1 << 20), "right")))
        size = int(ends[last - 1] - low)
        if size >= len(weights):
            weights, back = powers(base, size + 1), powers(pow(base, -1, 1 << 64), size + 1)
        total = np.zeros(size + 1, np.uint64)
        np.cumsum((data[low : low + size].astype(np.uint64) + np.uint64(1)) * weights[:size], out=total[1:])
        s, e = starts[first:last] - low, ends[first:last] - low
        out[first:last] = (total[e] - total[s]) * back[s]
        first = last
    return mixed(out ^ ((ends - starts).astype(np.uint64) * _ODD))


def within(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of ``n`` places lie in some slice; slices may touch or be empty."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, ends, -1)
    return np.cumsum(step[:-1], dtype=np.int32) > 0
