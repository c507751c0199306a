"""Exact encoding by distinct pieces of text between which no token reaches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from fixatlas.llm.ragged import bounds_of, spread, strings, within


class PieceCache:
    """Ids of pieces of text, kept by a Python worker over its tasks.

    Held are pieces of at most 64 bytes that came twice in one block, in at most about ``limit``
    bytes of memory; other pieces are encoded again in each block, which changes no result.
    """

    # What a piece takes beside its bytes: two objects and an entry of the table.
    ENTRY = 200

    def __init__(self, encode, limit: int = 24 << 20):
        self.encode, self.left, self.held = encode, limit, {}

    def ids(self, pieces: list[bytes], counts: list[int]) -> list[bytes]:
        """The little-endian unsigned 32-bit ids of each piece."""
        held = self.held
        out = [held.get(p) for p in pieces]
        missing = [i for i, ids in enumerate(out) if ids is None]
        for low in range(0, len(missing), 50_000):
            part = missing[low : low + 50_000]
            for i, ids in zip(part, self.encode([pieces[i] for i in part])):
                out[i] = ids
                size = self.ENTRY + len(pieces[i]) + len(ids)
                if counts[i] > 1 and len(pieces[i]) <= 64 and size <= self.left:
                    held[pieces[i]] = ids
                    self.left -= size
        return out


def encode_pieces(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, cache: PieceCache):
    """Ids of all slices in their order and their number by slice; equal slices are encoded once.

    The slices are in order and don't overlap.
    """
    body = data[within(len(data), starts, ends)]
    coded = strings(body, bounds_of(ends - starts)).dictionary_encode()
    which = np.asarray(coded.indices)
    pieces = coded.dictionary.to_pylist()
    del body, coded
    distinct = cache.ids(pieces, np.bincount(which, minlength=len(pieces)).tolist())
    flat = np.frombuffer(b"".join(distinct), np.uint32)
    sizes = np.fromiter((len(x) // 4 for x in distinct), np.int64, len(distinct))
    del pieces, distinct
    lengths = sizes[which]
    return flat[spread(bounds_of(sizes)[:-1][which], lengths)], lengths


def per_text(lengths: np.ndarray, piece_bounds: np.ndarray) -> np.ndarray:
    """Bounds of the ids by text, from the ids by piece and the pieces by text."""
    return bounds_of(lengths)[piece_bounds]


def id_list(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.astype(np.int32)))
