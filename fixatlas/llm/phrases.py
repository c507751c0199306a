"""Collocations mined by partitioning the corpus (SON).

The input's splits are dealt into ``SHARDS`` shards. A phrase that occurs ``least`` times in all has, in
some shard, at least its share of them, so each shard is mined completely at
``ceil(least / SHARDS)``; this holds however unequal the shards are. Mining goes by levels: words, pairs of frequent
words, then runs of three to ``LONGEST`` words all of whose pairs are frequent. It counts
40-bit hashes, in which different phrases may meet: that can only add candidates. What is frequent in
some shard is the candidate set of the whole corpus, and one more pass counts every occurrence
of a candidate by the text of its words, without hashes.

Counts are made in buckets of hash ranges; a task holds one bucket of one shard, and there are as many
buckets as the bytes of text ask for. A frequent phrase is one entry of each task that read it. Between
passes go bit maps of at most ``FILTER_BITS`` bits, whatever the corpus' size; a full
map lets more phrases through to be counted and loses none.

Words, pieces, counts, cuts and scores are those of ``collocations``.

Defined cases: null text is empty, null language is ``und``; a text of any length is read whole, one
text in one task; repeated rows count each; words are never empty, and pieces without words count
nothing; only language and text are read, whatever other columns are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fixatlas.llm.ragged import bounds_of, flat, gathered, lower_ascii, mixed, runs, slice_hashes, spread, strings, utf8
from fixatlas.llm.stored import stored

LONGEST = 5
SHARDS = 10
HASH_BITS = 40
FILTER_BITS = 1 << 28
BUCKET_BYTES = 64 << 20
HELD = 4_000_000
BLOCK = 4 << 20
SALTS = 8

STOPS = np.zeros(256, bool)
STOPS[list(b".,;:!?") + list(range(10, 14))] = True
GAPS = STOPS.copy()
GAPS[[9, 32]] = True


class Words:
    """The words of a block of texts: places, language and which are followed in their piece."""

    def __init__(self, table: pa.Table):
        data, bounds = utf8(table.column("text"))
        self.data = lower_ascii(data)
        self.starts, self.ends = runs(~GAPS[self.data], bounds)
        text = np.searchsorted(bounds, self.starts, "right") - 1
        codes = flat(table.column("lang")).dictionary_encode()
        self.langs = codes.dictionary
        self.lang = np.asarray(codes.indices).astype(np.int64)[text]
        stops = np.cumsum(STOPS[self.data], dtype=np.int32)[self.starts]
        n = len(self.starts)
        # follows[i]: word i + 1 stands in the piece of word i.
        self.follows = np.zeros(n, bool)
        self.follows[: n - 1] = (stops[1:] == stops[:-1]) & (text[1:] == text[:-1])

    def hashes(self) -> np.ndarray:
        """64-bit hashes of the words, each with its language."""
        own = slice_hashes(self.data, self.starts, self.ends)
        body, bounds = utf8(self.langs.cast(pa.large_string()))
        return mixed(own ^ slice_hashes(body, bounds[:-1], bounds[1:])[self.lang] * np.uint64(3)) if len(own) else own

    def occurrences(self, maps: list[np.ndarray], longest: int):
        """For 1 to ``longest`` words: first words of the runs that may be frequent, and their hashes.

        ``maps`` holds the bit maps of levels 1, 2 and, for longer runs, 3; what has no map yet is
        let through if all runs within it are.
        """
        h = one = self.hashes()
        may = np.ones(len(h), bool)
        for k in range(1, longest + 1):
            if k > 1:
                n = max(len(one) - k + 1, 0)
                may = may[:n] & may[1 : n + 1] & self.follows[k - 2 : n + k - 2] if n else np.zeros(0, bool)
                h = mixed(h[:n] * np.uint64(0x9E3779B97F4A7C15) + one[k - 1 :])
            if len(maps) >= min(k, 3):
                may = may & in_map(maps[min(k, 3) - 1], h)
            at = np.flatnonzero(may)
            yield k, at, h[at]

    def spaced(self) -> tuple[np.ndarray, np.ndarray]:
        """All words, one space after each, and where they begin: a phrase is one slice."""
        sizes = self.ends - self.starts
        begins = bounds_of(sizes + 1)
        out = np.full(begins[-1], 32, np.uint8)
        out[spread(begins[:-1], sizes)] = self.data[spread(self.starts, sizes)]
        return out, begins


def in_map(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the bit that stands for each hash is set; a map of n bits takes the first log2 n bits."""
    place = h >> np.uint64(64 - (8 * len(bits)).bit_length() + 1)
    return (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def pack(h: np.ndarray) -> bytes:
    """Hashes of 40 bits in five bytes each."""
    return np.ascontiguousarray(h.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def unpack(body: bytes) -> np.ndarray:
    out = np.zeros((len(body) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(body, np.uint8).reshape(-1, 5)
    return out.reshape(-1).view("<u8")


def summed(h: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in order and their counts."""
    if n is None:
        h = np.sort(h)
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
        return h[first], np.diff(np.append(first, len(h)))
    order = np.argsort(h, kind="stable")
    h, n = h[order], n[order]
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
    return h[first], np.add.reduceat(n, first) if len(first) else n


def frequent_somewhere(texts: DataFrame, low: int, high: int, maps, least: int, buckets: int) -> DataFrame:
    """Hashes of the runs of ``low`` to ``high`` words that are frequent in some shard, by bucket."""
    shift = np.uint64(HASH_BITS - (buckets.bit_length() - 1))
    local = -(-least // SHARDS)
    made = pa.schema([("shard", pa.int32()), ("bucket", pa.int32()), ("grams", pa.binary()), ("counts", pa.binary())])

    def count(batches):
        shard = TaskContext.get().partitionId() % SHARDS

        def entries(held):
            h, n = summed(np.concatenate(held))
            bucket = h >> shift
            edges = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            for a, b in zip(edges, np.append(edges[1:], len(h))):
                yield {"shard": shard, "bucket": int(bucket[a]), "grams": pack(h[a:b]), "counts": n[a:b].astype("<u4").tobytes()}

        def out(held):
            rows = []
            for row in entries(held):
                rows.append(row)
                if len(rows) == 64:
                    yield pa.RecordBatch.from_pylist(rows, made)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, made)

        held, size = [], 0
        levels = [m.value for m in maps]
        for table in gathered(batches, "text", BLOCK):
            for k, _, h in Words(table).occurrences(levels, high):
                if k >= low and len(h):
                    held.append(h >> np.uint64(64 - HASH_BITS))
                    size += len(h)
            if size >= HELD:
                yield from out(held)
                held, size = [], 0
        if held:
            yield from out(held)

    kept = pa.schema([("bucket", pa.int32()), ("grams", pa.binary())])

    def keep(key: tuple[pa.Scalar, ...], tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_h, held_n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in tables:
            new = [unpack(b) for b in batch.column("grams").to_pylist()]
            n = [np.frombuffer(b, "<u4").astype(np.int64) for b in batch.column("counts").to_pylist()]
            held_h, held_n = summed(np.concatenate([held_h, *new]), np.concatenate([held_n, *n]))
        frequent = held_h[held_n >= local]
        yield pa.RecordBatch.from_pydict({"bucket": [key[1].as_py()], "grams": [pack(frequent)]}, kept)

    counted = texts.mapInArrow(count, "shard int, bucket int, grams binary, counts binary")
    return counted.groupBy("shard", "bucket").applyInArrow(keep, "bucket int, grams binary").where("octet_length(grams) > 0")


def bit_map(found: DataFrame, buckets: int):
    """A broadcast bit map of the union of hashes; about 32 bits a hash up to ``FILTER_BITS``."""
    found = stored(found, "frequent")
    entries = (found.agg(F.sum(F.octet_length("grams"))).first()[0] or 0) // 5
    bits = 8 * buckets
    while bits < min(32 * entries, FILTER_BITS):
        bits *= 2
    wide, shift = bits // buckets, np.uint64(HASH_BITS - (bits.bit_length() - 1))

    def segment(key: tuple[pa.Scalar, ...], tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = np.zeros(wide, np.uint8)
        for batch in tables:
            for body in batch.column("grams").to_pylist():
                mine[(unpack(body) >> shift).astype(np.int64) - key[0].as_py() * wide] = 1
        body = np.packbits(mine, bitorder="little").tobytes()
        yield pa.RecordBatch.from_pydict({"bucket": [key[0].as_py()], "body": [body]}, pa.schema([("bucket", pa.int32()), ("body", pa.binary())]))

    whole = np.zeros(bits // 8, np.uint8)
    for row in found.groupBy("bucket").applyInArrow(segment, "bucket int, body binary").toLocalIterator():
        whole[row.bucket * wide // 8 : (row.bucket + 1) * wide // 8] = np.frombuffer(row.body, np.uint8)
    return found.sparkSession.sparkContext.broadcast(whole)


def exact_counts(texts: DataFrame, maps, least: int) -> DataFrame:
    """lang, phrase, k, n of the phrases of k words with n >= least; k = 0 counts all words of a language."""
    made = pa.schema([("lang", pa.string()), ("phrase", pa.large_string()), ("k", pa.int32()), ("n", pa.int64())])

    def count(batches):
        levels = [m.value for m in maps]
        for table in gathered(batches, "text", BLOCK):
            words = Words(table)
            if not len(words.starts):
                continue
            total = np.bincount(words.lang, minlength=len(words.langs))
            empty = pa.array([""] * len(total), pa.large_string())
            yield _counts(words.langs, np.arange(len(total)), empty, 0, total, made)
            body, begins = words.spaced()
            for k, at, _ in words.occurrences(levels, LONGEST):
                sizes = begins[at + k] - 1 - begins[at]
                bounds = bounds_of(sizes)
                coded = strings(body[spread(begins[at], sizes)], bounds, pa.large_string()).dictionary_encode()
                d = max(len(coded.dictionary), 1)
                key, n = summed(words.lang[at] * d + np.asarray(coded.indices))
                yield _counts(words.langs, key // d, coded.dictionary.take(pa.array(key % d)), k, n, made)

    counted = texts.mapInArrow(count, "lang string, phrase string, k int, n long")
    return counted.groupBy("lang", "phrase", "k").agg(F.sum("n").alias("n")).where((F.col("k") == 0) | (F.col("n") >= least))


def _counts(langs, lang, phrases, k, n, schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [langs.take(pa.array(lang)).cast(pa.string()), phrases, pa.array(np.full(len(n), k, np.int32)), pa.array(n.astype(np.int64))], schema=schema
    )


def phrase_counts(docs: DataFrame, least: int = 100, lang: str = "lang", text: str = "text") -> DataFrame:
    """Exact counts of all words and phrases of up to ``LONGEST`` words that occur ``least`` times."""
    texts = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = 1
    while buckets * BUCKET_BYTES < size:
        buckets *= 2
    maps = []
    for low, high in ((1, 1), (2, 2), (3, LONGEST)):
        maps.append(bit_map(frequent_somewhere(texts, low, high, maps, least, buckets), buckets))
    return exact_counts(texts, maps, least)


def _part(low: Column, size: Column) -> Column:
    return F.array_join(F.slice("words", low, size), " ")


def _salted(counts: DataFrame, name: str) -> DataFrame:
    """Counts by (lang, salt, phrase), words once for each salt."""
    salt = F.when(F.col("k") < 2, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return counts.select("lang", F.explode(salt).alias(f"{name}_salt"), F.col("phrase").alias(f"{name}_part"), F.col("n").alias(name))


def scored(counts: DataFrame) -> DataFrame:
    """Phrases of two words and more with a, l, r, n and the score of the cut that scores least.

    l and r count the parts of a cut, n all words of the language; the score is
    floor(1000 a n / (l r)). Parts that very many phrases share, and the languages, are joined in ``SALTS`` slices.
    """
    own = F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int")
    phrases = counts.where("k >= 2").select("lang", "phrase", "k", F.col("n").alias("a"), F.split("phrase", " ").alias("words"), own.alias("own"))
    cuts = phrases.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.select(
        "lang", "phrase", "k", "a", "cut", "own",
        _part(F.lit(1), F.col("cut")).alias("l_part"), _part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("r_part"),
        F.when(F.col("cut") == 1, F.col("own")).otherwise(0).alias("l_salt"),
        F.when(F.col("k") - F.col("cut") == 1, F.col("own")).otherwise(0).alias("r_salt"),
    )
    parts = counts.where("k >= 1")
    cuts = cuts.join(_salted(parts, "l"), ["lang", "l_salt", "l_part"]).join(_salted(parts, "r"), ["lang", "r_salt", "r_part"])
    totals = _salted(counts.where("k = 0"), "n").select("lang", F.col("n_salt").alias("own"), "n")
    cuts = cuts.join(totals, ["lang", "own"])
    wide = {c: F.col(c).cast("decimal(19,0)") for c in ("a", "l", "r", "n")}
    cuts = cuts.select(
        "lang", "phrase", "k", "a", "cut", "l", "r", "n",
        (F.lit(1000).cast("decimal(4,0)") * wide["a"]).alias("top"), wide["n"].alias("wide_n"), (wide["l"] * wide["r"]).alias("under"),
    ).withColumn("score", F.expr("(cast(top as decimal(23,0)) * wide_n) div under"))
    best = cuts.groupBy("lang", "phrase", "k").agg(F.min(F.struct("score", "cut", "a", "l", "r", "n")).alias("best"))
    return best.select("lang", "phrase", "k", "best.*")


def not_covered(phrases: DataFrame, percent: int) -> DataFrame:
    """Phrases that lie in no longer one with at least ``percent`` per cent of their count."""
    places = F.expr("""
      flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1), i -> array_join(slice(split(phrase, ' '), i, m), ' '))))
    """)
    inner = phrases.where("k > 2").select("lang", F.explode(places).alias("phrase"), "a")
    longer = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    covered = F.coalesce(F.col("longer"), F.lit(0)) * 100 >= F.col("a") * percent
    return phrases.join(longer, ["lang", "phrase"], "left").where(~covered).drop("longer")


def collocations(docs: DataFrame, least: int = 100, percent: int = 100, shown: int = 2000, lang: str = "lang", text: str = "text") -> DataFrame:
    """The ``shown`` first phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A-Z is lowered, texts are cut at ``.,;:!?`` and line ends into pieces and those at spaces and tabs into
    words. Phrases have 2 to 5 words of one piece and occur ``least`` times. The order is by score and count,
    greatest first, then by the bytes of the phrase.
    """
    counts = stored(phrase_counts(docs, least, lang, text), "phrase-counts")
    left = not_covered(stored(scored(counts), "scored"), percent)
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # First within slices of a language, so that no task sorts all its phrases.
    sliced = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    left = left.withColumn("rank", F.row_number().over(sliced)).where(F.col("rank") <= shown)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    return left.withColumn("rank", rank).where(F.col("rank") <= shown).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
