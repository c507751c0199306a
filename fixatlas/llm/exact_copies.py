"""Exact copies by a tree of merged digest runs.

Every row becomes a SHA-256 digest of its text without white space. Rows of one stretch of the
input form a leaf run: its distinct digests in order, each with its best row and its number
of rows. Runs are then merged in rounds: a run's address is a number in base ``FAN``, and in round r
the runs whose addresses differ in digit r alone exchange their entries, each keeping those whose
digest has its own digit there. What arrives is merged in the order of the digests, and equal
entries (same digest and same length in bytes) become one with the least row by (most code
points, smallest id) and the sum of rows. After the last round each digest lies in one run, and
the answers go back the same way, from each run to those that it merged.

An entry meets at most ``FAN`` equal ones in a round, and a leaf holds each digest once, so a text
that a third of all rows share costs no task more than any other. Each level is written to the
shared folder, where the way back reads it and where it outlives its executors.

Defined cases: null text is empty, and all empty texts are equal; a null id counts as the
largest; rows that repeat an id and a text are equal rows of which the first one read stays; an empty
table gives no rows; only the id and the text are read, whatever other columns are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fixatlas.llm.stored import parts, stored

FAN = 16
RUN_ROWS = 1 << 16
SPACE = " \t\n\x0b\x0c\r"
ENTRY = ["digest", "n_bytes"]


def rounds_for(rows: int, least_runs: int) -> int:
    """Rounds until there are as many runs as asked and none has over ``RUN_ROWS`` rows on average."""
    rounds = 1
    while FAN**rounds < max(least_runs, -(-rows // RUN_ROWS)):
        rounds += 1
    return rounds


def digit_of_digest(k: int) -> Column:
    """Digit ``k`` in base 16 of the digest, beginning at the first."""
    byte = F.conv(F.hex(F.substring("digest", k // 2 + 1, 1)), 16, 10).cast("long")
    return F.shiftright(byte, 4) if k % 2 == 0 else byte.bitwiseAND(15)


def handed_on(address: Column, k: int) -> Column:
    """The address of the run that an entry goes to in round ``k``."""
    old = F.pmod(F.floor(address / F.lit(FAN**k)), F.lit(FAN))
    return (address + (digit_of_digest(k) - old) * F.lit(FAN**k)).cast("long")


def merged(runs: DataFrame, k: int) -> DataFrame:
    """The runs after round ``k``."""
    moved = runs.withColumn("run", handed_on(F.col("run"), k))
    in_order = moved.repartition(parts(runs.sparkSession), "run").sortWithinPartitions("run", *ENTRY)
    return in_order.groupBy("run", *ENTRY).agg(F.min("best").alias("best"), F.sum("n").alias("n"))


def exact_copies(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: id, keep_id (id of the row that stays), group_size, kept, digest (binary)."""
    spark = docs.sparkSession
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(id_column).alias("id"),
        F.length(whole).alias("points"),
        F.translate(whole, SPACE, "").alias("bare"),
        F.monotonically_increasing_id().alias("at"),
    )
    rows = rows.select("id", "points", "at", F.unhex(F.sha2("bare", 256)).alias("digest"), F.octet_length("bare").alias("n_bytes"))
    rows = stored(rows, "digests")
    rounds = rounds_for(rows.count(), parts(spark))
    # The row number within a partition is in the low 33 bits of ``at``.
    leaf = F.pmod(F.xxhash64(F.shiftright("at", 16)), F.lit(FAN**rounds))
    rows = rows.withColumn("run", leaf)

    best = F.struct((-F.col("points")).alias("short"), F.col("id").isNull().alias("unknown"), "id", "at")
    levels = [stored(rows.groupBy("run", *ENTRY).agg(F.min(best).alias("best"), F.count("*").alias("n")), "runs")]
    for k in range(rounds):
        levels.append(stored(merged(levels[-1], k), "runs"))

    answers = levels.pop().select("run", *ENTRY, "best.id", "best.at", "n")
    for k in reversed(range(rounds)):
        asked = levels.pop().select("run", *ENTRY, handed_on(F.col("run"), k).alias("asks"))
        found = answers.withColumnRenamed("run", "asks")
        answers = stored(asked.join(found, ["asks", *ENTRY]).select("run", *ENTRY, "id", "at", "n"), "answers")

    answers = answers.select("run", *ENTRY, F.col("id").alias("keep_id"), F.col("at").alias("keep_at"), F.col("n").alias("group_size"))
    return rows.join(answers, ["run", *ENTRY]).select(
        F.col("id").alias(id_column), "keep_id", "group_size", (F.col("at") == F.col("keep_at")).alias("kept"), "digest"
    )
