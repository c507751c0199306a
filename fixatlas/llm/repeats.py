"""Bytes of documents that repeat a passage of an earlier document, by a depth-limited radix sort.

A byte is removed if some string of ``depth`` bytes that covers it also starts in a document
with a smaller id. Only suffixes that could be equal so far are sorted, and only through
``depth`` bytes, most significant digit first:

* First digit: the anchor. Of the 16-byte strings in the window at a suffix's start, the one
  with the least hash (the leftmost of equals); equal windows have equal anchors at the same
  distance. Anchors are counted by hash over all documents, and suffixes whose anchor is met
  in one document only are left out; about one anchor stands for 18 suffixes.
* Then digits of 8 bytes. A group splits where a digit differs; suffixes alone in their group
  drop out. What is equal after the last digit are exactly the repeated windows.

Work goes by blocks of some megabytes of text, stored once. In a block, windows shared by its own documents
are sorted first: all but those of the smallest id are removed there and then, so however
common a passage is, a block asks about it only for one document. What is left goes to
the task of its anchor's hash, as the anchor with the bytes around it, and is sorted there
against other blocks' windows. Nothing is broadcast.

Defined cases: null is an empty text; texts shorter than ``depth`` keep all; a null doc_id is
smaller than all others; documents with the same id don't remove from each other; an empty
table gives an empty result; other columns are passed through, those named like a result
are replaced.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fixatlas.llm.ragged import bounds_of, gathered, mixed, runs, spread, strings, utf8, within
from fixatlas.llm.stored import parts, stored

DEPTH, GRAM, BLOCK_BYTES, CHUNK, LEVEL = 50, 16, 4 << 20, 1 << 17, 3
RESULT = ["kept", "n_bytes", "n_removed", "n_spans"]


def pack(*arrays: np.ndarray) -> bytes:
    head = json.dumps([[a.dtype.str, len(a)] for a in arrays]).encode()
    body = len(head).to_bytes(4, "little") + head + b"".join(a.tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=LEVEL).compress(body)


def unpack(blob: bytes) -> list[np.ndarray]:
    body = zstandard.ZstdDecompressor().decompress(blob)
    at = 4 + int.from_bytes(body[:4], "little")
    out = []
    for kind, n in json.loads(body[4:at]):
        out.append(np.frombuffer(body, kind, n, at))
        at += out[-1].nbytes
    return out


def starts_packed(starts: np.ndarray) -> bytes:
    """Window starts as runs of neighbours: first ones (as steps) and lengths."""
    starts = np.unique(starts)
    first = np.flatnonzero(np.append(True, starts[1:] != starts[:-1] + 1))[: len(starts)]
    length = np.diff(np.append(first, len(starts)))
    return pack(np.diff(starts[first].astype(np.int32), prepend=np.int32(0)), length.astype(np.int32))


def covered(blob: bytes, n: int, depth: int) -> np.ndarray:
    """Which of ``n`` bytes the windows of packed starts cover."""
    step, length = unpack(blob)
    first = np.cumsum(step, dtype=np.int64)
    return within(n, first, first + length - 1 + depth)


def _words_at(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place as a number; ``data`` has 8 bytes more than places."""
    return np.ndarray((max(len(data) - 7, 0),), ">u8", np.ascontiguousarray(data), strides=(1,))


def anchors(data: np.ndarray, bounds: np.ndarray, depth: int = DEPTH):
    """First and last window start, place and hash of each anchor, in order of their starts."""
    reach = depth - GRAM + 1
    n = len(data) - depth + 1
    if n <= 0:
        return [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)]
    crossing = within(len(data), np.maximum(bounds[:-1], bounds[1:] - depth + 1), bounds[1:])
    low_bits = np.uint64(63)
    out = [[], [], [], []]
    for c in range(0, n, CHUNK):
        size = min(CHUNK, n - c)
        places = size + reach - 1
        words = _words_at(data[c : c + size + depth - 1 + 8] if c + size + depth + 7 <= len(data) else np.append(data[c:], np.zeros(8, np.uint8)))
        a, b = words[:places].astype(np.uint64), words[8 : 8 + places].astype(np.uint64)
        a *= np.uint64(0x9E3779B97F4A7C15)
        a ^= a >> np.uint64(29)
        b *= np.uint64(0xC2B2AE3D27D4EB4F)
        b ^= b >> np.uint64(32)
        a += b
        a *= np.uint64(0x165667B19E3779F9)
        a ^= a >> np.uint64(31)
        # The least hash and, in the low bits, its distance from the window's start.
        least, width = a & ~low_bits, 1
        while width < reach:
            step = min(width, reach - width)
            least = np.minimum(least[: len(least) - step], least[step:] + np.uint64(step))
            width += step
        place = np.arange(c, c + size) + (least & low_bits).astype(np.int64)
        valid = ~crossing[c : c + size]
        new = valid.copy()
        same = place[1:] == place[:-1]
        new[1:] &= ~(same & valid[:-1])
        end = valid.copy()
        end[:-1] &= ~(same & valid[1:])
        first = np.flatnonzero(new)
        for held, x in zip(out, (first + c, np.flatnonzero(end) + c, place[first], least[first] & ~low_bits)):
            held.append(x)
    return [np.concatenate(x) for x in out]


def equal_windows(data: np.ndarray, starts: np.ndarray, labels: np.ndarray, depth: int):
    """Groups of equal windows among those with equal labels: (indices by group, group numbers).

    ``data`` has 8 spare bytes at its end. Windows without an equal are left out.
    """
    order = np.argsort(labels, kind="stable")
    lab = labels[order]
    new = np.append(True, lab[1:] != lab[:-1])[: len(lab)]
    words = _words_at(data)

    def shared(order, new):
        group = np.cumsum(new) - 1
        keep = np.bincount(group)[group] > 1 if len(group) else np.zeros(0, bool)
        return order[keep], (np.cumsum(new[keep]) - 1) if len(group) else group

    order, group = shared(order, new)
    for at in [*range(0, depth - 8, 8), depth - 8]:
        if not len(order):
            break
        digit = words[starts[order] + at].astype(np.uint64)
        new = np.append(True, group[1:] != group[:-1])
        differs = digit != digit[np.flatnonzero(new)][group]
        if not differs.any():
            continue
        torn = np.flatnonzero(np.bincount(group, differs)[group] > 0)
        again = torn[np.lexsort((digit[torn], group[torn]))]
        order[torn], digit[torn] = order[again], digit[again]
        new[1:] |= digit[1:] != digit[:-1]
        order, group = shared(order, new)
    return order, group


def _later(order: np.ndarray, group: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Of grouped windows, those in a document with a larger id than the group's least."""
    if not len(order):
        return order
    firsts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    mine = doc[order]
    return order[mine > np.minimum.reduceat(mine, firsts)[group]]


def later_windows(data, begins, rel, n, keys, doc, depth: int, limit: int = 1 << 19):
    """Windows that a smaller document has too: (context, number of the window in it).

    A context is ``n`` windows in a row from ``begins``, all with one anchor, ``rel`` bytes after
    the first; only contexts with equal keys are compared. Keys are taken in turn, as many as
    have about ``limit`` windows together.
    """
    by_key = np.argsort(keys, kind="stable")
    windows = bounds_of(n[by_key])
    edges = np.append(np.flatnonzero(np.append(True, keys[by_key][1:] != keys[by_key][:-1])) if len(keys) else 0, len(keys))
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    at = 0
    while at < len(edges) - 1:
        upto = max(at + 1, int(np.searchsorted(windows[edges], windows[edges[at]] + limit, "right")) - 1)
        part = by_key[edges[at] : edges[upto]]
        at = upto
        if len(part) < 2:
            continue
        context = np.repeat(part, n[part])
        step = spread(np.zeros(len(part), np.int64), n[part])
        _, which = np.unique(keys[part], return_inverse=True)
        labels = np.repeat(which * 64 + rel[part], n[part]) - step
        order, group = equal_windows(data, begins[context] + step, labels, depth)
        gone = _later(order, group, doc[context])
        found.append((context[gone], step[gone]))
    return [np.concatenate(x) for x in zip(*found)]


class Block:
    """A block's texts with their anchors; the same in every pass, since computed from the text."""

    def __init__(self, blob: bytes, depth: int, buckets: int):
        raw = zstandard.ZstdDecompressor().decompress(blob)
        self.table = pa.ipc.open_stream(raw).read_all().combine_chunks()
        self.data, self.bounds = utf8(self.table.column("text"))
        self.depth, self.buckets = depth, buckets
        ids = self.table.column("doc_id").cast(pa.int64()).fill_null(np.iinfo(np.int64).min)
        self.doc_ids = ids.to_numpy()

    def find_anchors(self) -> None:
        self.first, self.last, self.place, hashes = anchors(self.data, self.bounds, self.depth)
        self.doc = np.searchsorted(self.bounds, self.first, "right") - 1
        self.hashes, self.which = np.unique(hashes, return_inverse=True)
        spreads = mixed(self.hashes)
        self.bucket = (spreads % np.uint64(self.buckets)).astype(np.int32)
        # With the bucket this tells hashes apart but for few; those cost a look, no result.
        self.keys = (spreads >> np.uint64(32)).astype("<u4")
        low, high = np.full(len(self.hashes), np.iinfo(np.int64).max), np.full(len(self.hashes), np.iinfo(np.int64).min)
        ids = self.doc_ids[self.doc]
        np.minimum.at(low, self.which, ids)
        np.maximum.at(high, self.which, ids)
        self.several = low < high

    def by_bucket(self):
        order = np.argsort(self.bucket, kind="stable")
        cuts = np.searchsorted(self.bucket[order], np.arange(self.buckets + 1))
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            yield b, order[cuts[b] : cuts[b + 1]]

    def windows(self, chosen: np.ndarray):
        """Starts and anchors of all windows of the chosen anchors."""
        n = self.last[chosen] - self.first[chosen] + 1
        return spread(self.first[chosen], n), np.repeat(chosen, n)


def _stored_blocks(depth: int, buckets: int):
    """Blocks, and the anchor hashes of each by bucket."""

    def run(batches):
        task, number = TaskContext.get(), 0
        for table in gathered(batches, "text", BLOCK_BYTES):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as writer:
                writer.write_table(table)
            blob = zstandard.ZstdCompressor(level=LEVEL).compress(sink.getvalue())
            block = Block(blob, depth, buckets)
            block.find_anchors()
            name = ((task.partitionId() if task else 0) << 24) | number
            number += 1
            rows = [(None, blob, None)]
            for b, at in block.by_bucket():
                rows.append((b, None, block.keys[at].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([name] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int32()),
                    pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary()),
                ],
                ["block", "bucket", "texts", "keys"],
            )

    return run


def _met_elsewhere(table: pa.Table) -> pa.Table:
    """For one bucket: of each block's hashes, those that another block has as well."""
    rows = table.column("keys").to_pylist()
    sizes = np.array([len(r) // 4 for r in rows])
    keys = np.frombuffer(b"".join(rows), "<u4")
    order = np.argsort(keys, kind="stable")
    equal = keys[order][1:] == keys[order][:-1]
    met = np.zeros(len(keys), bool)
    met[order[1:][equal]] = True
    met[order[:-1][equal]] = True
    ends = bounds_of(sizes)
    replies = [pack(np.flatnonzero(met[a:b]).astype(np.uint32)) for a, b in zip(ends, ends[1:])]
    return pa.table([table.column("block"), table.column("bucket"), pa.array(replies, pa.binary())], ["block", "bucket", "met"])


def _sorted_within(depth: int, buckets: int):
    """For one block: its own repeats, and what has to be compared with other blocks."""

    def run(key, texts, replies):
        block = Block(texts.column("texts")[0].as_py(), depth, buckets)
        block.find_anchors()
        met = np.zeros(len(block.hashes), bool)
        answers = dict(zip(replies.column("bucket").to_pylist(), replies.column("met").to_pylist()))
        for b, at in block.by_bucket():
            if b in answers:
                met[at[unpack(answers[b])[0]]] = True
        padded = np.append(block.data, np.zeros(8, np.uint8))
        own = np.flatnonzero(block.several[block.which])
        first = block.first[own]
        context, step = later_windows(
            padded, first, block.place[own] - first, block.last[own] - first + 1, block.which[own],
            block.doc_ids[block.doc[own]], depth,
        )
        removed = first[context] + step
        settled = np.zeros(len(block.data) + 1, bool)
        settled[removed] = True
        del padded, own, first, context, step
        # Of each anchor that other blocks have: the span of its windows that are still open.
        asked = np.flatnonzero(met[block.which])
        starts, owner = block.windows(asked)
        still = ~settled[starts]
        starts, owner = starts[still], owner[still]
        cut = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))[: len(owner)]
        low, high = starts[cut], starts[np.append(cut[1:], len(starts)) - 1] if len(starts) else starts
        asked = owner[cut]
        rows = [(buckets + key[0].as_py() % buckets, starts_packed(removed))]
        bucket = block.bucket[block.which[asked]]
        for b in np.unique(bucket).tolist():
            at = np.flatnonzero(bucket == b)
            a, n = low[at], high[at] - low[at] + 1
            body = block.data[spread(a, n + depth - 1)]
            mine = asked[at]
            names, doc = np.unique(block.doc_ids[block.doc[mine]], return_inverse=True)
            rows.append((b, pack(
                names, np.diff(doc.astype(np.int32), prepend=np.int32(0)), np.diff(a.astype(np.int32), prepend=np.int32(0)),
                block.keys[block.which[mine]], (block.place[mine] - a).astype(np.uint8), n.astype(np.uint8), body,
            )))
        return pa.table(
            [pa.array([key[0].as_py()] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())],
            ["block", "bucket", "payload"],
        )

    return run


def _sorted_across(depth: int, buckets: int):
    """For one bucket: windows of different blocks, sorted together; what each block removes.

    What blocks found by themselves comes in buckets of its own and goes on as it is.
    """

    def run(key, table):
        if key[0].as_py() >= buckets:
            return table.select(["block", "payload"])
        blocks = table.column("block").to_numpy()
        blobs = []
        for names, doc, low, *rest in (unpack(p) for p in table.column("payload").to_pylist()):
            blobs.append((names[np.cumsum(doc)], np.cumsum(low), *rest))
        doc, low, keys, rel, n, body = (np.concatenate(x) for x in zip(*blobs))
        owner = np.repeat(np.arange(len(blobs)), [len(b[0]) for b in blobs])
        del blobs
        n, low = n.astype(np.int64), low.astype(np.int64)
        context, step = later_windows(
            np.append(body, np.zeros(8, np.uint8)), bounds_of(n + depth - 1)[:-1], rel.astype(np.int64), n, keys, doc, depth
        )
        order = np.argsort(owner[context], kind="stable")
        context, step = context[order], step[order]
        place = low[context] + step
        cuts = np.searchsorted(owner[context], np.arange(len(blocks) + 1))
        replies = [starts_packed(place[a:b]) for a, b in zip(cuts, cuts[1:])]
        return pa.table([pa.array(blocks, pa.int64()), pa.array(replies, pa.binary())], ["block", "payload"])

    return run


def _whole_characters(data: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """Keeps every character of which a byte is kept."""
    lead = (data & 0xC0) != 0x80
    char = np.cumsum(lead) - 1
    kept = np.bincount(char, ~gone, int(char[-1]) + 1 if len(char) else 0) > 0
    return ~kept[char]


def _applied(depth: int, as_text: bool, schema: pa.Schema):
    def run(key, texts, removals):
        block = Block(texts.column("texts")[0].as_py(), depth, 1)
        gone = np.zeros(len(block.data), bool)
        for blob in removals.column("payload").to_pylist():
            gone |= covered(blob, len(gone), depth)
        if as_text:
            gone = _whole_characters(block.data, gone)
        first, _ = runs(gone, block.bounds)
        upto = bounds_of(gone.astype(np.int64))[block.bounds]
        n_bytes = np.diff(block.bounds)
        kept = strings(block.data[~gone], bounds_of(n_bytes - np.diff(upto)))
        table = block.table
        made = {
            "n_bytes": pa.array(n_bytes), "n_removed": pa.array(np.diff(upto)),
            "n_spans": pa.array(np.diff(np.searchsorted(first, block.bounds))),
            "text" if as_text else "kept": kept.cast(pa.large_string()) if as_text else kept,
        }
        return pa.table([made[f.name] if f.name in made else table.column(f.name) for f in schema], schema=None, names=schema.names).cast(schema)

    return run


def remove_repeats(docs: DataFrame, depth: int = DEPTH, as_text: bool = False) -> DataFrame:
    """The documents without repeated bytes.

    Other columns of ``docs``, then n_bytes, n_removed, n_spans (maximal removed runs), and either
    ``kept`` (the bytes left) in place of the text, or, with ``as_text``, the text itself with characters
    that lost all their bytes removed (one that kept a byte stays whole; counts are of these).
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    if depth < GRAM + 8 or depth - GRAM > 62:
        raise ValueError("windows of 24 to 78 bytes can be sorted")
    docs = docs.drop(*RESULT)
    buckets = parts(docs.sparkSession)
    first = stored(
        docs.mapInArrow(_stored_blocks(depth, buckets), "block long, bucket int, texts binary, keys binary"), "repeat-blocks"
    )
    blocks = first.where("texts is not null").select("block", "texts")
    met = (
        first.where("keys is not null").select("block", "bucket", "keys")
        .groupBy("bucket").applyInArrow(_met_elsewhere, "block long, bucket int, met binary")
    )
    # One job from here on: both joins with the blocks read the same shuffle of them.
    removals = (
        blocks.groupBy("block").cogroup(met.groupBy("block"))
        .applyInArrow(_sorted_within(depth, buckets), "block long, bucket int, payload binary")
        .groupBy("bucket").applyInArrow(_sorted_across(depth, buckets), "block long, payload binary")
    )
    counts = [T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")]
    own = [f for f in docs.schema if as_text or f.name != "text"]
    out = T.StructType([*own, *counts] if as_text else [*own, *counts, T.StructField("kept", T.BinaryType())])
    return blocks.groupBy("block").cogroup(removals.groupBy("block")).applyInArrow(
        _applied(depth, as_text, to_arrow_schema(out)), out
    )
