"""Scores of whole texts under a causal self-attention model, beside a count of words.

Tokens are words (runs of bytes other than white space, A-Z as small letters) and one end.
The model sees the words' subword ids (each word with a space before it) and the end, so a
text's probability is the product over all of them; ids beyond the most common share a class and
are told apart by their counts.

1. One pass cuts the table into blocks and stores each as ids, with the block's own distinct
   words. Words are counted in two steps (block, then all), each block gets back the totals of
   its own words, and no table of all words is sent anywhere.
2. Subword ids are counted over all learning documents; so are pairs of neighbouring classes,
   which fix the model's starting point.
3. Training windows tile every learning document, so each id is learnt as a target once, at any size
   of the corpus. The windows of a block are dealt to ``ROUNDS`` rounds; blocks train each on their
   own, and parameters are averaged after each round, level by level.
4. All texts are scored, block by block.

Words are told apart by 64 bits of hash. Defined cases: null is an empty text, which is one end;
a null doc_id counts as the empty text where its hash is taken; repeated rows are scored (and
learnt) each; without learning documents all counts are 0 and the model is the uniform start; other
columns are not read.
"""

from __future__ import annotations

import math
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixatlas.llm import attention
from fixatlas.llm.ragged import bounds_of, flat, gathered, lower_ascii, mixed, runs, slice_hashes, spread, utf8
from fixatlas.llm.repeats import pack, unpack
from fixatlas.llm.stored import parts, stored

END, IDS = 50_256, 50_257  # the tokenizer's ids, and the free one for the end
CLASSES = 32 * attention.GROUPS
ROUNDS, FAN = 4, 16
BLOCK_BYTES = 8 << 20
KNOWN = 3 << 20  # ids of words that a worker holds from block to block

BLOCKS = """block long, bucket int, body binary, keys binary, learning long,
  sub_ids array<int>, sub_counts array<long>"""
RESULT = """doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long,
  base_score double, score double"""

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


@cache
def _subwords(path: str):
    """Encodes many words at once, each with a space before it; so only the first id of a word has one."""
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    coding = tiktoken.Encoding("subwords", pat_str="[ ][^ ]*", mergeable_ranks=ranks, special_tokens={})
    opens = np.zeros(IDS, bool)
    opens[[i for word, i in ranks.items() if word[:1] == b" "]] = True

    def encode(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words that are slices of ``data``, and the size of each."""
        if not len(starts):
            return np.zeros(0, np.uint16), np.zeros(0, np.int64)
        sizes = ends - starts
        joined = np.full(int(sizes.sum()) + len(sizes), 32, np.uint8)
        joined[spread(np.cumsum(sizes + 1) - sizes, sizes)] = data[spread(starts, sizes)]
        ids = np.array(coding.encode_ordinary(joined.tobytes().decode()), np.uint16)
        return ids, np.diff(np.append(np.flatnonzero(opens.take(ids)), len(ids)))

    known = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint16)

    def remembering(hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """Ids of words and their bounds, for distinct words in the order of their hashes; words of
        earlier blocks are looked up, of which at most ``KNOWN`` ids are held."""
        nonlocal known
        if len(known[3]) > KNOWN:
            known = tuple(x[:0] for x in known)
        held, at, size, ids = known
        place = np.searchsorted(held, hashes)
        seen = np.append(held, np.uint64(0)).take(place) == hashes
        seen &= place < len(held)
        more, sizes = encode(data, starts[~seen], ends[~seen])
        ids = np.concatenate([ids, more])
        first, many = np.empty(len(hashes), np.int64), np.empty(len(hashes), np.int64)
        first[seen], many[seen] = at.take(place[seen]), size.take(place[seen])
        first[~seen], many[~seen] = len(ids) - len(more) + np.cumsum(sizes) - sizes, sizes
        held = np.concatenate([held, hashes[~seen]])
        order = np.argsort(held, kind="stable")
        known = (
            held.take(order), np.concatenate([at, first[~seen]]).take(order),
            np.concatenate([size, sizes]).take(order), ids,
        )
        return ids.take(spread(first, many)), bounds_of(many)

    return remembering


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def _counted(path: str, buckets: int):
    def run(batches):
        encode, task, number = _subwords(path), TaskContext.get(), 0
        for table in gathered(batches, "text", BLOCK_BYTES):
            # Learning documents stand first, so that what is learnt is one piece.
            out_of = np.array([held_out(i) for i in table.column("doc_id").to_pylist()], bool)
            by_use = np.argsort(out_of, kind="stable")
            table, out_of = table.take(by_use), out_of[by_use]
            data, bounds = utf8(table.column("text"))
            data = lower_ascii(data)
            ids = flat(table.column("doc_id"))
            starts, ends = runs(~_SPACE[data], bounds)
            by_text = np.searchsorted(starts, bounds)
            hashes, first, which = np.unique(slice_hashes(data, starts, ends), return_index=True, return_inverse=True)
            counts = np.bincount(which[: by_text[np.count_nonzero(~out_of)]], minlength=len(hashes))
            subwords, sub_bounds = encode(hashes, data, starts[first], ends[first])
            sizes = np.diff(sub_bounds)
            total = np.bincount(subwords, np.repeat(counts, sizes), IDS).astype(np.int64)
            total[END] = int((~out_of).sum())
            used = np.flatnonzero(total)
            spreads = mixed(hashes)
            bucket = (spreads % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            # Distinct words stand in the order of their buckets, as the totals will come back.
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            missing = np.asarray(ids.is_null()).astype(np.uint8)
            body = pack(
                ids.fill_null(0).to_numpy(), missing, out_of.astype(np.uint8), np.diff(by_text).astype(np.uint32),
                rank[which], sizes[order].astype(np.uint32), subwords[spread(sub_bounds[:-1][order], sizes[order])].astype(np.uint16),
                np.diff(cuts).astype(np.uint32),
            )
            name = ((task.partitionId() if task else 0) << 24) | number
            number += 1
            rows = [(None, body, None, int((~out_of).sum()), used, total[used])]
            for b in np.flatnonzero(np.diff(cuts)).tolist():
                at = order[cuts[b] : cuts[b + 1]]
                rows.append((b, None, pack(spreads[at], counts[at].astype(np.uint32)), None, None, None))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([name] * len(rows), pa.int64()),
                    *(pa.array([r[i] for r in rows], kind) for i, kind in enumerate(
                        (pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()))
                    )),
                ],
                ["block", "bucket", "body", "keys", "learning", "sub_ids", "sub_counts"],
            )

    return run


def _totalled(table: pa.Table) -> pa.Table:
    """For one bucket of words: totals over all blocks, given back to each in its own order."""
    sent = [unpack(x) for x in table.column("keys").to_pylist()]
    sizes = [len(k) for k, _ in sent]
    keys, which = np.unique(np.concatenate([k for k, _ in sent]), return_inverse=True)
    total = np.bincount(which, np.concatenate([c for _, c in sent])).astype(np.int64)
    small = total.max(initial=0) < 2**32
    ends = bounds_of(np.array(sizes))
    back = [pack(total[which[a:b]].astype(np.uint32 if small else np.int64)) for a, b in zip(ends, ends[1:])]
    head = [1] + [0] * (len(back) - 1)
    return pa.table(
        [
            table.column("block"), table.column("bucket"), pa.array(back, pa.binary()),
            pa.array([h * int(total.sum()) for h in head]), pa.array([h * int((total > 0).sum()) for h in head]),
        ],
        ["block", "bucket", "totals", "n", "v"],
    )


class Texts:
    """A stored block: documents, their words as places among its distinct words, and ids."""

    def __init__(self, body: bytes):
        ids, missing, out_of, words, self.which, sizes, self.subwords, self.bucket_sizes = unpack(body)
        self.doc_ids = pa.array(ids, mask=missing.astype(bool))
        self.held_out, self.words = out_of.astype(bool), bounds_of(words.astype(np.int64))
        self.sub_bounds = bounds_of(sizes.astype(np.int64))

    def line(self, n: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Subword ids of the first ``n`` texts, each between two ends, and bounds of texts with the end before."""
        words = self.words if n is None else self.words[: n + 1]
        which = self.which[: words[-1]]
        size_of = np.diff(self.sub_bounds)
        sizes = size_of.astype(np.int32).take(which)
        inner = bounds_of(sizes).take(words)
        bounds = bounds_of(np.diff(inner) + 2)
        out = np.full(bounds[-1], END, np.uint16)
        # One run over all ids; from word to word and from text to text the source and the place step on.
        ends = np.cumsum(sizes, dtype=np.int32)
        step = np.arange(inner[-1], dtype=np.int32)
        source = step + np.repeat(self.sub_bounds[:-1].astype(np.int32).take(which) - ends + sizes, sizes)
        step += np.repeat((bounds[:-1] + 1 - inner[:-1]).astype(np.int32), np.diff(inner))
        out[step] = self.subwords.take(source)
        return out, bounds


def _line(texts: Texts, class_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all learning texts of a block, each text with its beginning, and their bounds."""
    ids, bounds = texts.line(int(np.count_nonzero(~texts.held_out)))
    return class_of.take(ids), bounds


def training_windows(line: np.ndarray, bounds: np.ndarray, r: int) -> np.ndarray:
    """The windows of round ``r``: over all rounds every class after a beginning is a target once."""
    many = -(-(np.diff(bounds) - 1) // attention.WINDOW)
    text = np.repeat(np.arange(len(many)), many)
    at = (np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)) * attention.WINDOW
    text, at = text[r::ROUNDS], at[r::ROUNDS]
    places = (bounds[text] + at)[:, None] + np.arange(attention.WINDOW + 1)
    return np.where(places < bounds[text + 1][:, None], line.take(places, mode="clip"), -1)


def _part_row(payload: bytes) -> pa.RecordBatch:
    task = TaskContext.get()
    return pa.RecordBatch.from_arrays(
        [pa.array([task.partitionId() if task else 0], pa.int64()), pa.array([payload], pa.binary())], ["part", "payload"]
    )


def _pairs(class_of: np.ndarray):
    """Per task: counts of neighbouring classes."""

    def run(batches):
        pairs = np.zeros(CLASSES * CLASSES, np.int64)
        for batch in batches:
            for body in batch.column("body").to_pylist():
                line, bounds = _line(Texts(body), class_of)
                if len(line):
                    pairs += np.bincount(line[:-1] * CLASSES + line[1:], minlength=len(pairs))
                    pairs -= np.bincount(line[bounds[1:-1] - 1] * CLASSES + line[bounds[1:-1]], minlength=len(pairs))
        used = np.flatnonzero(pairs)
        yield _part_row(pack(used.astype(np.uint32), pairs[used]))

    return run


def level_by_level(rows: DataFrame, n_parts: int, merge) -> bytes | None:
    """Merges the payloads of parts numbered below ``n_parts``, ``FAN`` at a time, to one."""

    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py() // FAN
        return pa.table([[part], pa.array([merge(table.column("payload").to_pylist())], pa.binary())], ["part", "payload"])

    rows = rows.select("part", "payload")
    while True:
        rows = rows.groupBy(F.floor(F.col("part") / FAN)).applyInArrow(run, "part long, payload binary")
        n_parts = -(-n_parts // FAN)
        if n_parts <= 1:
            break
    found = rows.collect()
    return bytes(merge([r.payload for r in found])) if found else None


def _add_pairs(payloads: list[bytes]) -> bytes:
    total = np.zeros(CLASSES * CLASSES, np.int64)
    for p in payloads:
        at, n = unpack(p)
        total[at] += n
    used = np.flatnonzero(total)
    return pack(used.astype(np.uint32), total[used])


def _add_parameters(payloads: list[bytes]) -> bytes:
    """Sums of parameters times windows, and of windows."""
    both = [unpack(p) for p in payloads]
    return pack(np.sum([s for s, _ in both], axis=0), np.sum([n for _, n in both], axis=0))


def _names(p: dict) -> list[str]:
    return sorted(k for k in p if k not in attention.FIXED)


def _trained_part(held, class_of: np.ndarray, r: int):
    """Per task: the sum of what its blocks' windows of round ``r`` train from the common parameters."""

    def run(batches):
        p, rate = held.value, 0.028 * (1, 0.6, 0.6, 0.3)[r]
        total, n = np.zeros(sum(p[k].size for k in _names(p))), 0
        for batch in batches:
            for body in batch.column("body").to_pylist():
                rows = training_windows(*_line(Texts(body), class_of), r)
                if len(rows):
                    new = attention.train(p, rows, rate=rate, seed=r)
                    total += np.concatenate([new[k].reshape(-1) for k in _names(p)]).astype(np.float64) * len(rows)
                    n += len(rows)
        yield _part_row(pack(total, np.array([n], np.float64)))

    return run


def _trained(blocks: DataFrame, n_parts: int, class_of: np.ndarray, p: dict) -> dict:
    """Rounds of training by tasks and averaging."""
    for r in range(ROUNDS):
        held = blocks.sparkSession.sparkContext.broadcast(p)  # its size is that of the model, whatever the data's
        one = blocks.select("body").mapInArrow(_trained_part(held, class_of, r), "part long, payload binary")
        result = level_by_level(one, n_parts, _add_parameters)
        sums, n = unpack(result) if result else (None, np.zeros(1))
        if n[0] == 0:
            return p
        mean, at, new = (sums / n[0]).astype(np.float32), 0, dict(p)
        for k in _names(p):
            new[k] = mean[at : at + p[k].size].reshape(p[k].shape)
            at += p[k].size
        p = new
    return p


def _scored(model, class_of: np.ndarray, rare: np.ndarray, n_words: int, n_distinct: int, n_ends: int, begin: int):
    """Both scores of every text of a block."""
    log10 = lambda c: np.log10((c + 0.1) / (n_words + 0.1 * (n_distinct + 1)))

    def run(bodies, totals):
        texts = Texts(bodies.column("body")[0].as_py())
        answers = dict(zip(totals.column("bucket").to_pylist(), totals.column("totals").to_pylist()))
        filled = np.flatnonzero(texts.bucket_sizes).tolist()
        count = np.concatenate([np.zeros(0, np.int64), *(unpack(answers[b])[0].astype(np.int64) for b in filled)])
        sums = lambda x: np.diff(bounds_of_float(x)[texts.words])
        base = sums(log10(count).take(texts.which)) + log10(n_ends)
        known = np.diff(bounds_of((count > 0).astype(np.int64).take(texts.which))[texts.words]) + (n_ends > 0)
        ids, bounds = texts.line()
        ids, bounds = np.delete(ids, bounds[:-1]), bounds - np.arange(len(bounds))
        found = attention.log_probabilities(model.value, class_of.take(ids), bounds, begin) + rare.take(ids)
        score = np.add.reduceat(found, bounds[:-1]) / math.log(10) if len(bounds) > 1 else np.zeros(0)
        n = len(texts.held_out)
        return pa.table(
            [
                texts.doc_ids, pa.array(texts.held_out), pa.array(np.diff(texts.words) + 1), pa.array(known),
                pa.array(np.full(n, n_words, np.int64)), pa.array(base), pa.array(score),
            ],
            ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    return run


def bounds_of_float(x: np.ndarray) -> np.ndarray:
    return np.append(0.0, np.cumsum(x))


def language_scores(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """One row for each document, see ``RESULT``; learns from those that are not held out."""
    spark = docs.sparkSession
    buckets = parts(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    first = stored(rows.mapInArrow(_counted(tokenizer_path, buckets), BLOCKS), "word-blocks")
    blocks = first.where("body is not null").select("block", "body")
    totals = stored(
        first.where("keys is not null").select("block", "bucket", "keys").groupBy("bucket")
        .applyInArrow(_totalled, "block long, bucket int, totals binary, n long, v long"),
        "word-totals",
    )
    n, v = totals.agg(F.sum("n"), F.sum("v")).first()
    n_ends = first.agg(F.sum("learning")).first()[0] or 0
    # One number for each id of the tokenizer.
    counts = np.zeros(IDS, np.int64)
    pairs = first.where("sub_ids is not null").select(F.explode(F.arrays_zip("sub_ids", "sub_counts")).alias("x"))
    for i, c in pairs.groupBy("x.sub_ids").agg(F.sum("x.sub_counts")).collect():
        counts[i] = c
    common = [END, *(i for i in np.argsort(-counts, kind="stable").tolist() if i != END)][: CLASSES - 1]
    class_of = np.full(IDS, CLASSES - 1, np.int64)
    class_of[common] = np.arange(len(common))
    others = class_of == CLASSES - 1
    rare = np.where(others, np.log((counts + 0.1) / (counts[others] + 0.1).sum()), 0.0)
    n_parts = blocks.rdd.getNumPartitions()
    seen = blocks.select("body").mapInArrow(_pairs(class_of), "part long, payload binary")
    merged = level_by_level(seen, n_parts, _add_pairs)
    matrix = np.zeros(CLASSES * CLASSES)
    if merged:
        at, c = unpack(merged)
        matrix[at] = c
    matrix = matrix.reshape(CLASSES, CLASSES)
    # Classes in an order that makes groups of neighbours.
    order = attention.arranged(matrix)
    place = np.argsort(order)
    start = attention.start(matrix[order][:, order])
    model = _trained(blocks, n_parts, place[class_of], start)
    score = _scored(
        spark.sparkContext.broadcast(model), place[class_of], rare, int(n or 0) + n_ends, int(v or 0) + (n_ends > 0), n_ends, int(place[0])
    )
    return (
        blocks.groupBy("block").cogroup(totals.select("block", "bucket", "totals").groupBy("block")).applyInArrow(score, RESULT)
    )
