"""Quality of documents from statistics of their whole texts, by boosted trees.

The statistics of every text are computed in one pass over the table and kept. The trees
learn from the labelled documents, at most ``SAMPLE`` of them (the first by a hash of the id, of which only about
so many are sorted);
language, source, id and labels are no statistics.

Defined cases: null text is an empty text, which has statistics and a score as any other; null
or unknown labels teach nothing; a null doc_id counts as the empty text where its hash is
taken and never joins a label; repeated rows all get their score; without labels every score is 0.5; input columns that have the
name of a result column are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fixatlas.llm import boosted
from fixatlas.llm.ragged import flat, gathered, runs, slice_hashes, utf8
from fixatlas.llm.stored import stored

SAMPLE = 40_000
# Texts in a block: their counts of bytes are a table of 256 numbers a text.
TEXTS = 4096
NAMES = [
    "log_bytes", "log_words", "capitals", "digits", "spaces", "line_feeds", "beyond_ascii", "exclamation", "stops",
    "brackets", "bars", "odd_signs", "quotes", "slashes", "controls", "word_bytes", "word_spread", "longest_word",
    "short_words", "distinct_words", "top_word", "same_as_last", "ending_signs", "log_lines", "distinct_lines",
    "log_line_bytes", "distinct_pairs",
]
_CLASSES = {
    "capitals": range(65, 91), "digits": range(48, 58), "spaces": b" \t", "line_feeds": b"\n\r", "beyond_ascii": range(128, 256),
    "exclamation": b"!?", "stops": b".,;:", "brackets": b"()[]{}<>", "bars": b"|_=~^", "odd_signs": b"#$%&*+@", "quotes": b"\"'`",
    "slashes": b"/\\", "controls": [*range(9), *range(11, 13), *range(14, 32), 127],
}


def _distinct(text: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values by text and the count of the most common one (44 bits of hash tell them apart)."""
    key = (text.astype(np.uint64) << np.uint64(44)) | (hashes >> np.uint64(20))
    key.sort()
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    owner = (key[new] >> np.uint64(44)).astype(np.int64)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, owner, np.diff(np.append(new, len(key))))
    return np.bincount(owner, minlength=n), most


def statistics(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One row of numbers for each text, in the order of ``NAMES``; at most 2**20 texts at once."""
    n, sizes = len(bounds) - 1, np.diff(bounds)
    of_byte = np.repeat(np.arange(n, dtype=np.int32), sizes)
    bytes_ = np.bincount(of_byte * 256 + data, minlength=256 * n).reshape(n, 256) if len(data) else np.zeros((n, 256), np.int64)
    share = lambda a, b: a / np.maximum(b, 1)
    out = {name: share(bytes_[:, [*chosen]].sum(axis=1), sizes) for name, chosen in _CLASSES.items()}
    starts, ends = runs(data > 32, bounds)
    owner = np.searchsorted(bounds, starts, "right") - 1
    lengths = ends - starts
    words = np.bincount(owner, minlength=n)
    hashes = slice_hashes(data, starts, ends)
    distinct, most = _distinct(owner, hashes, n)
    mean = share(np.bincount(owner, lengths, n), words)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, owner, lengths)
    follows = np.append(False, owner[1:] == owner[:-1]) if len(owner) else np.zeros(0, bool)
    again = follows & np.append(False, hashes[1:] == hashes[:-1]) if len(owner) else follows
    pairs = hashes[1:] * np.uint64(3) + hashes[:-1] if len(owner) else hashes
    distinct_pairs, _ = _distinct(owner[1:][follows[1:]], pairs[follows[1:]], n)
    last = data[ends - 1] if len(ends) else data[:0]
    sign = (last < 48) | ((last > 57) & (last < 65)) | ((last > 90) & (last < 97)) | ((last > 122) & (last < 128))
    line_starts, line_ends = runs(data != 10, bounds)
    line_owner = np.searchsorted(bounds, line_starts, "right") - 1
    lines = np.bincount(line_owner, minlength=n)
    distinct_lines, _ = _distinct(line_owner, slice_hashes(data, line_starts, line_ends), n)
    out |= {
        "log_bytes": np.log1p(sizes), "log_words": np.log1p(words), "word_bytes": mean,
        "word_spread": np.sqrt(np.maximum(share(np.bincount(owner, lengths.astype(float) ** 2, n), words) - mean**2, 0)),
        "longest_word": np.log1p(longest), "short_words": share(np.bincount(owner, lengths <= 3, n), words),
        "distinct_words": share(distinct, words), "top_word": share(most, words),
        "same_as_last": share(np.bincount(owner, again, n), words), "ending_signs": share(np.bincount(owner, sign, n), words),
        "log_lines": np.log1p(lines), "distinct_lines": share(distinct_lines, lines),
        "log_line_bytes": np.log1p(share(sizes, lines)), "distinct_pairs": share(distinct_pairs, words - 1),
    }
    return np.stack([out[name] for name in NAMES], axis=1).astype(np.float32)


def _by_batch(df: DataFrame, text: str, keep: list[str], name: str, kind, made) -> DataFrame:
    """``df`` with one more column, made of the statistics of each block of texts."""
    kept = [c for c in keep if c != name]
    rows = df.select(*dict.fromkeys([*kept, text]))
    schema = T.StructType([*(rows.schema[c] for c in kept), T.StructField(name, kind)])

    def run(batches):
        for table in gathered(batches, text, 2 << 20, TEXTS):
            own = [flat(table.column(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*own, made(statistics(*utf8(table.column(text))))], [*kept, name])

    return rows.mapInArrow(run, schema)


def with_statistics(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    def made(x):
        return pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), len(NAMES)).cast(pa.list_(pa.float32()))

    return _by_batch(docs, text, docs.columns if keep is None else keep, "stats", T.ArrayType(T.FloatType()), made)


def held_out(doc_id="doc_id"):
    """Documents that are not learnt from: a quarter, by the id's CRC-32."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def learn(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> boosted.Trees:
    """Trees from ``doc_id``, ``stats`` and ``doc_id``, ``quality``."""
    known = labels.where("quality in (0, 1)").select("doc_id", "quality").where(~held_out())
    known = stored(known, "known-labels")
    # With many labels only the ids with a small hash come to the sort, a few more than are taken.
    bound = 1.1 * sample / max(known.count(), 1)
    if bound < 1:
        known = known.where(F.xxhash64("doc_id") < F.lit((int(bound * (1 << 32)) << 32) - (1 << 63)))
    rows = (
        stats.select("doc_id", "stats").join(known, "doc_id")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "stats", "quality").limit(sample).toArrow()
    )
    column = rows.column("stats").combine_chunks()
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), len(NAMES))
    return boosted.fit(x, rows.column("quality").to_numpy().astype(float))


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(NAMES))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id and score of every row of ``docs``."""
    stats = stored(with_statistics(docs, keep=["doc_id"]), "statistics")
    trees = learn(stats, labels)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(trees.score(matrix(batch.column("stats"))))], ["doc_id", "score"]
            )

    return stats.mapInArrow(run, T.StructType([stats.schema["doc_id"], T.StructField("score", T.DoubleType())]))


def keep_good(docs: DataFrame, labels: DataFrame, least: float) -> DataFrame:
    """The documents with a score of at least ``least``, with the columns they had."""
    trees = learn(stored(with_statistics(docs, keep=["doc_id"]), "statistics"), labels)
    name = "score"
    while name in docs.columns:
        name += "_"
    scored = _by_batch(docs, "text", docs.columns, name, T.DoubleType(), lambda x: pa.array(trees.score(x)))
    return scored.where(F.col(name) >= least).drop(name)
