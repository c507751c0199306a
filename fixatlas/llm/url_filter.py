"""Listed URLs found with a blocked Bloom filter and an exact hash join.

A rule is a host and a path. It fits the URLs of its host and all subdomains whose path starts
with the rule's; of several that fit, the longest (host and path together, then host) wins.
A URL has one key for each (host suffix, path start) that some rule could have, by the label
counts and path lengths that occur among the rules. The keys are looked up in a split-block
Bloom filter of the rules; what it lets pass goes, once for each distinct URL and key, to an
exact join with the rules, which removes the false positives.

The filter has at most ``MAX_BLOCKS`` blocks of 64 bytes however long the list is, so its
broadcast is bounded; a longer list only makes it pass more keys to the join.

Defined cases: a null URL or one without ``://`` has an empty host and path, which no rule
fits; rules with a null or empty host are left out, a null path means ``/``; of equal rules
with different verdicts, block wins; with no rules at all every URL is allowed; repeated rows are all
kept; other input columns are passed through, those named like a result are replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BLOCKS = 1 << 18
KEYS_PER_BLOCK = 32
RESULT = ["host", "path", "rule", "verdict"]

_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url) -> tuple:
    """Column expressions: host in small ASCII letters, path up to the query or fragment."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _CAPITALS, _SMALL), path


def canonical_rules(rules: DataFrame) -> DataFrame:
    """key, rule (host and path as one text), host_labels, path_chars, verdict; one row per rule.

    In the key a slash parts host and path: no host of a URL holds one, so equal keys have equal hosts.
    """
    host = F.translate("host", _CAPITALS, _SMALL)
    path = F.coalesce(F.nullif(F.col("path"), F.lit("")), F.lit("/"))
    rows = rules.where("host <> ''").select(host.alias("host"), path.alias("path"), "verdict")
    return (
        rows.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # block over allow
        .select(
            F.concat("host", F.lit("/"), "path").alias("key"),
            F.concat("host", "path").alias("rule"),
            F.size(F.split("host", r"\.")).alias("host_labels"),
            F.length("path").alias("path_chars"),
            F.length("host").alias("host_chars"),
            "verdict",
        )
    )


def _hashes(key) -> tuple:
    return F.xxhash64(key), F.xxhash64(key, F.lit(1))


def bloom_filter(keys: DataFrame, n_blocks: int) -> np.ndarray:
    """Eight 64-bit words for each block; each key sets one bit in each word of its block."""
    block, bits = _hashes(F.col(keys.columns[0]))
    rows = keys.select(F.pmod(block, F.lit(n_blocks)).alias("block"), bits.alias("bits"))
    words = [
        F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(bits, {6 * j}) & 63 as int))")).alias(f"w{j}")
        for j in range(8)
    ]
    out = np.zeros((n_blocks, 8), np.uint64)
    found = rows.groupBy("block").agg(*words).toPandas()
    if len(found):
        out[found["block"].to_numpy()] = found[[f"w{j}" for j in range(8)]].to_numpy().astype(np.int64).view(np.uint64)
    return out


def in_filter(words: np.ndarray, block: np.ndarray, bits: np.ndarray) -> np.ndarray:
    bits = bits.astype(np.int64).view(np.uint64)
    row = words[np.mod(block, len(words))]
    result = np.ones(len(block), bool)
    for j in range(8):
        place = (bits >> np.uint64(6 * j)) & np.uint64(63)
        result &= ((row[:, j] >> place) & np.uint64(1)).astype(bool)
    return result


def _keys(labels: list[int], lengths: list[int]):
    """All keys of a URL that could be a rule's: host suffixes by label count, path starts by length."""
    n = F.size(F.split("host", r"\."))
    hosts = F.array_compact(
        F.array(*[F.when(n >= k, F.substring_index("host", ".", -k)) for k in labels])
    )
    paths = F.array_compact(
        F.array(*[F.when(F.length("path") >= k, F.substring("path", 1, k)) for k in lengths])
    )
    return F.array_distinct(F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, F.lit("/"), p)))))


def judge(urls: DataFrame, rules: DataFrame, url: str = "url", otherwise: str = "allow") -> DataFrame:
    """Adds host, path, rule (null if none fits) and verdict.

    ``rules``: host, path, verdict (allow or block).
    """
    spark = urls.sparkSession
    rules = canonical_rules(rules)
    host, path = host_and_path(F.col(url))
    named = urls.drop(*RESULT).withColumns({"host": host, "path": path})
    shape = rules.agg(
        F.count("*").alias("n"),
        F.collect_set("host_labels").alias("labels"),
        F.collect_set("path_chars").alias("lengths"),
    ).first()
    if not shape.n:
        return named.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(otherwise)})
    n_blocks = 1
    while n_blocks < MAX_BLOCKS and n_blocks * KEYS_PER_BLOCK < shape.n:
        n_blocks *= 2
    table = spark.sparkContext.broadcast(bloom_filter(rules.select("key"), n_blocks))

    @F.pandas_udf("boolean")
    def may_be_listed(block: pd.Series, bits: pd.Series) -> pd.Series:
        return pd.Series(in_filter(table.value, block.to_numpy(), bits.to_numpy()))

    # One row for each distinct host and path; their keys, thinned by the filter.
    candidates = (
        named.where("host <> ''").select("host", "path").distinct()
        .select("host", "path", F.explode(_keys(sorted(shape.labels), sorted(shape.lengths))).alias("key"))
    )
    possible = candidates.where(may_be_listed(*_hashes(F.col("key"))))
    fitting = possible.join(rules, "key")
    order = F.struct(F.length("rule").alias("a"), F.col("host_chars").alias("b"), F.col("rule").alias("c"))
    best = fitting.groupBy("host", "path").agg(
        F.max_by(F.struct("rule", "verdict"), order).alias("best")
    )
    return (
        named.join(best, ["host", "path"], "left")
        .withColumns({"rule": F.col("best.rule"), "verdict": F.coalesce("best.verdict", F.lit(otherwise))})
        .select(*named.columns, "rule", "verdict")
    )
