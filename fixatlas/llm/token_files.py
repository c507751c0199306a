"""Token ids of documents in packed binary files, in the order of the document ids.

Each row of the written table is one file segment (``simple8b``) of about ``SEGMENT_IDS`` ids.
Documents are dealt by ranges of ``doc_id`` and sorted within a range, so the ranges, and the
segments in them, follow each other. ``start`` of a document is the number of ids before it
in all segments.

Defined cases: null text is empty and has the closing id only; an empty table gives an empty
table; rows with the same ``doc_id`` are kept all, ordered by text; a null ``doc_id`` sorts
first; other columns are not read, whatever their names.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fixatlas.llm import simple8b
from fixatlas.llm.ragged import bounds_of, flat, gathered, utf8
from fixatlas.llm.stored import parts, stored
from fixatlas.llm.words import PieceCache, encode_pieces, per_text

SEGMENT_IDS = 1 << 21
SEGMENT_SCHEMA = "part int, segment int, before long, n_ids long, doc_ids array<long>, content binary"
# A private-use character that stands between pieces encoded in one call.
_BETWEEN = "\ue000"


@cache
def _piece_cache(path: str) -> PieceCache:
    return PieceCache(_piece_encoder(path))


def _piece_encoder(path: str):
    """Encodes many pieces in few calls of the library."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    mark = np.array(tokenizer.encode(_BETWEEN, add_special_tokens=False).ids, np.uint32)

    def alone(piece: bytes) -> bytes:
        ids = tokenizer.encode(piece.decode("utf-8"), add_special_tokens=False).ids
        return np.array(ids, np.uint32).tobytes()

    def encode(pieces: list[bytes]) -> list[bytes]:
        out: list[bytes] = [b""] * len(pieces)
        # The mark's first id stands for a byte that only private-use characters have.
        easy = [i for i, p in enumerate(pieces) if b"\xee" not in p]
        for i in set(range(len(pieces))) - set(easy):
            out[i] = alone(pieces[i])
        groups = [easy[i : i + 200] for i in range(0, len(easy), 200)]
        texts = [f" {_BETWEEN} ".join(pieces[i].decode("utf-8") for i in g) for g in groups]
        for first in range(0, len(groups), 64):
            coded = tokenizer.encode_batch_fast(texts[first : first + 64], add_special_tokens=False)
            for group, e in zip(groups[first : first + 64], coded):
                ids = np.array(e.ids, np.uint32)
                cuts = np.flatnonzero(ids == mark[0])
                if len(cuts) != len(group) - 1:
                    for i in group:
                        out[i] = alone(pieces[i])
                    continue
                lows = np.concatenate([[0], cuts + len(mark)]).tolist()
                highs = np.concatenate([cuts, [len(ids)]]).tolist()
                for i, low, high in zip(group, lows, highs):
                    out[i] = ids[low:high].tobytes()
        return out

    return encode


_STOPS = np.isin(np.arange(256), np.frombuffer(b".,!?;:", np.uint8))


def _pieces(data: np.ndarray, bounds: np.ndarray):
    """Bytes and slices that are encoded by themselves, and their number by text.

    The tokenizer drops white space before it looks at words and ends a word between an ASCII
    letter and a stop; so cutting before spaces, line feeds and such stops changes no id.
    Nor do small letters for A-Z, but for a letter that a combining mark follows (U+0300 to
    U+036F begin with 0xCC or 0xCD) and for texts that may hold a special token (``<|``).
    """
    blank = (data == 32) | (data == 10)
    capital = (data >= 65) & (data <= 90)
    capital[:-1] &= (data[1:] != 0xCC) & (data[1:] != 0xCD)
    special = (data[:-1] == 60) & (data[1:] == 124)
    if special.any():
        texts = np.unique(np.searchsorted(bounds, np.flatnonzero(special), "right") - 1)
        for t in texts.tolist():
            capital[bounds[t] : bounds[t + 1]] = False
    begins = blank.copy()
    letter = ((data | 32) >= 97) & ((data | 32) <= 122)
    begins[1:] |= _STOPS[data[1:]] & letter[:-1]
    begins[bounds[:-1][np.diff(bounds) > 0]] = True
    data = data + (capital.view(np.uint8) << 5)
    starts = np.flatnonzero(begins)
    return data, starts + blank[starts], np.append(starts[1:], len(data)), np.searchsorted(starts, bounds)


def _encoded(path: str, closing: int):
    def run(batches):
        task = TaskContext.get()
        part, before, number = task.partitionId() if task else 0, 0, 0
        held, count = [], 0

        def segment():
            nonlocal before, number
            docs = pa.concat_arrays([d for d, _, _ in held])
            ids = np.concatenate([v for _, v, _ in held])
            bounds = bounds_of(np.concatenate([n for _, _, n in held]))
            out = pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([part], pa.int32()),
                    "segment": pa.array([number], pa.int32()),
                    "before": pa.array([before], pa.int64()),
                    "n_ids": pa.array([len(ids)], pa.int64()),
                    "doc_ids": pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs),
                    "content": pa.array([simple8b.to_segment(ids, bounds)], pa.binary()),
                }
            )
            before, number = before + len(ids), number + 1
            return out

        for table in gathered(batches, "text"):
            data, bounds = utf8(table.column("text"))
            data, starts, ends, by_text = _pieces(data, bounds)
            ids, lengths = encode_pieces(data, starts, ends, _piece_cache(path))
            ids, after = simple8b.joined(ids, per_text(lengths, by_text), closing)
            docs = flat(table.column("doc_id"))
            # Segments hold whole documents; a block of them is cut where it grows too large.
            first = 0
            while first < len(docs):
                last = int(np.searchsorted(after, after[first] + SEGMENT_IDS - count, "right")) - 1
                last = min(len(docs), max(last, first + (not held)))
                if last > first:
                    held.append((docs.slice(first, last - first), ids[after[first] : after[last]], np.diff(after[first : last + 1])))
                    count += int(after[last] - after[first])
                    first = last
                if first < len(docs):
                    yield segment()
                    held, count = [], 0
        if held:
            yield segment()

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, closing: int = 1, ranges: int | None = None) -> None:
    """Encodes ``doc_id``, ``text`` and writes the segments to the folder ``path``."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dealt = rows.repartitionByRange(ranges or parts(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    dealt.mapInArrow(_encoded(tokenizer_path, closing), SEGMENT_SCHEMA).write.parquet(path)


def _decoded(batches):
    for batch in batches:
        for row in range(batch.num_rows):
            ids, bounds = simple8b.from_segment(batch.column("content")[row].as_py())
            docs = batch.column("doc_ids")[row].values
            n = len(docs)
            body = pa.py_buffer(ids.astype("<u4"))
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": docs,
                    "part": pa.repeat(batch.column("part")[row], n),
                    "start_in_part": pa.array(bounds[:-1] + batch.column("before")[row].as_py(), pa.int64()),
                    "n_tokens": pa.array(np.diff(bounds), pa.int64()),
                    "ids": pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((bounds * 4).astype(np.int32)), body]),
                }
            )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document: doc_id, start, n_tokens, ids (little-endian unsigned 32-bit).

    The ids before each range come from one small row per range.
    """
    segments = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    # One small row for each range: their number is the writer's parameter, not the data's size.
    sums = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    found = segments.select("part", "before", "doc_ids", "content").mapInArrow(
        _decoded, "doc_id long, part int, start_in_part long, n_tokens long, ids binary"
    )
    return found.join(F.broadcast(bases), "part").select(
        "doc_id", (F.col("start_in_part") + F.col("base")).alias("start"), "n_tokens", "ids"
    )
