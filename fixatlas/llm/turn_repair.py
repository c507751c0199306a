"""Least edits that turn conversations into ``(system? (user assistant)+)?``.

Rows are turned into codes of one byte: which of the three roles its initial stands for, whether it must
go, whether its text is cut off. The edits are found by dynamic programming over the four states of the
pattern. Only at every square root of the rows is the vector of costs to the end (one number a
state) held; the walk forward computes the vectors between two such checkpoints anew and takes,
of the edits that lie on a cheapest way, the one whose initial is least in ASCII.

A conversation of any length is cut into stretches of about the square root of the longest one, which are worked on in
tasks of their own: their costs are 4 x 4 tables, which joined from the back give the
vector at each stretch's end; walks from all four states then give each stretch's first state. A task gathers
the stretches of a conversation as small numbers and never its texts. Texts are dealt once, in
the order of turns, and stream by with their edits.

Faults: ``blank`` texts have white space only, ``duplicate`` rows repeat role and text of an earlier
one, ``truncated`` texts don't end in ``.``, ``!`` or ``?``; a row has the first that fits.

Defined cases: null role and text are one space; null turns come first and are no gaps; rows of one turn
come in the order of role and SHA-256 of role and text, repeated rows next to each other; a null conversation is a conversation
of its own; roles of other initials, empty ones too, can't be kept; an empty table gives no rows;
only conv_id, turn, role and text are read. The digest of a conversation reads its texts in order in one
task, a row at a time.
"""

from __future__ import annotations

import hashlib
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixatlas.llm.stored import parts, stored

SPACE = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
NEVER = 1 << 60
# Codes: role initial (0 other, 1 s, 2 u, 3 a), 4 if the text is cut off, 8 if the row must go.
TRUNCATED, MUST_GO = 4, 8
# States: 0 nothing yet, 1 after s, 2 after u, 3 after a. The role that R and I give next, as a state.
NEXT = (2, 2, 3, 2)
AT_END = (0, 2 * INSERT, INSERT, 0)
ROLE = {2: "user", 3: "assistant"}


def kept_state(state: int, initial: int) -> int | None:
    """The state after keeping a row, or None where the pattern doesn't allow it."""
    if initial == 1:
        return 1 if state == 0 else None
    return initial if initial and initial == NEXT[state] else None


def _ways(code: int):
    """For each state the (initial, cost, next state) of what can be done with a row of this code."""
    out, more = [], CUT_OFF if code & TRUNCATED else 0
    for state in range(4):
        ways = [("D", DELETE, state)]
        if not code & MUST_GO:
            after = kept_state(state, code & 3)
            if after is not None:
                ways.append(("K", more, after))
            ways.append(("R", REROLE + more, NEXT[state]))
        out.append(ways)
    return out


WAYS = [_ways(code) for code in range(16)]


def before(code: int, v: tuple) -> tuple:
    """Costs to the end before a row, from those after it."""
    b = [min([cost + v[to] for _, cost, to in ways]) for ways in WAYS[code]]
    u, a = min(b[2], INSERT + b[3]), min(b[3], INSERT + b[2])
    return min(b[0], INSERT + u), min(b[1], INSERT + u), u, a


def costs_before(codes: bytes, v: tuple) -> tuple:
    for code in reversed(codes):
        v = before(code, v)
    return v


def table(codes: bytes) -> list[int]:
    """Least costs from each state before the rows to each state after them, as 16 numbers."""
    ends = [costs_before(codes, tuple(0 if p == q else NEVER for q in range(4))) for p in range(4)]
    return [min(ends[p][q], NEVER) for q in range(4) for p in range(4)]


def through(costs: list[int], v: tuple) -> tuple:
    """``costs_before`` by a table."""
    return tuple(min(costs[4 * q + p] + v[p] for p in range(4)) for q in range(4))


def tight_edits(codes: bytes, end: tuple, state: int) -> tuple[list[str], int]:
    """Edits by row (inserts before it, then its own) of the ASCII-least cheapest way, and the last state."""
    step = isqrt(len(codes)) + 1
    held, v = [], end
    for low in reversed(range(0, len(codes), step)):
        held.append(v)
        v = costs_before(codes[low : low + step], v)
    out = []
    for low in range(0, len(codes), step):
        vectors = [held.pop()]
        for code in reversed(codes[low : low + step]):
            vectors.append(before(code, vectors[-1]))
        for code in codes[low : low + step]:
            here, after, edits = vectors.pop(), vectors[-1], ""
            while True:
                tight = {e: to for e, cost, to in WAYS[code][state] if cost + after[to] == here[state]}
                if "D" in tight:
                    out.append(edits + "D")
                    break
                if INSERT + here[NEXT[state]] == here[state]:
                    edits, state = edits + "I", NEXT[state]
                    continue
                e = min(tight)
                out.append(edits + e)
                state = tight[e]
                break
    return out, state


def closing(state: int) -> str:
    """Inserts after the last row."""
    return "I" * (AT_END[state] // INSERT)


def _pairs(initials: np.ndarray) -> int:
    """How many neighbours are not su, ua or au."""
    one, two = initials[:-1], initials[1:]
    return int((~(((one == 1) & (two == 2)) | ((one == 2) & (two == 3)) | ((one == 3) & (two == 2)))).sum())


def in_order(rows: DataFrame) -> DataFrame:
    """Distinct rows of a turn with their number ``n``, without texts; ``at`` grows in their order."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    bare = F.rtrim(text, F.lit(SPACE))
    first = F.substring("role", 1, 1)
    named = rows.select(
        "conv_id", F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("")).alias("conv"), "turn", role.alias("role"),
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("key"),
        (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("open"), text.alias("text"),
    )
    initial = F.when(first == "s", 1).when(first == "u", 2).when(first == "a", 3).otherwise(0)
    return named.withColumn("initial", initial)


# Nulls come first, as they do by default.
ORDER = ["conv", "turn", "role", "key"]


def stretches(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The ordered rows, and their stretches with codes and counts of faults."""
    spark = rows.sparkSession
    named = in_order(rows).groupBy("conv", "turn", "role", "key", "blank", "open", "initial").agg(F.count("*").alias("n"))
    ordered = named.repartitionByRange(parts(spark), *ORDER).sortWithinPartitions(*ORDER)
    ordered = stored(ordered.withColumn("at", F.monotonically_increasing_id()), "turns")
    longest = ordered.groupBy("conv").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    shift = max(6, (isqrt(longest)).bit_length())
    stretch = F.shiftright("at", shift).alias("stretch")

    # The place of each role and text that comes first in its conversation.
    firsts = ordered.groupBy("conv", "key").agg(F.min("at").alias("at"))
    firsts = firsts.groupBy("conv", stretch).agg(F.collect_list("at").alias("firsts"))
    row = F.struct("at", "n", "blank", "open", "initial")
    whole = ordered.groupBy("conv", stretch).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    joined = whole.join(firsts, ["conv", "stretch"], "left")

    def code(batches):
        for batch in batches:
            made = {name: [] for name in _STRETCH.names}
            made["conv"], made["stretch"] = batch.column("conv"), batch.column("stretch")
            for rows_, firsts_ in zip(batch.column("rows").to_pylist(), batch.column("firsts").to_pylist()):
                first, codes, at, n = set(firsts_ or ()), [], [], []
                blank = duplicate = truncated = 0
                for r in rows_:
                    again = r["n"] if r["at"] not in first else r["n"] - 1
                    gone = r["initial"] | MUST_GO
                    if r["blank"]:
                        blank, one = blank + r["n"], gone
                    else:
                        duplicate += again
                        truncated += r["open"] * (r["n"] - again)
                        one = gone if again == r["n"] else r["initial"] | TRUNCATED * r["open"]
                    codes += [bytes([one]), bytes([gone]) * (r["n"] - 1)]
                    at.append(r["at"])
                    n.append(r["n"])
                codes = b"".join(codes)
                initials = np.frombuffer(codes, np.uint8) & 3
                for name, value in zip(
                    _STRETCH.names[2:],
                    (codes, at, n, blank, duplicate, truncated, _pairs(initials), int(initials[0]), int(initials[-1]), table(codes)),
                ):
                    made[name].append(value)
            yield pa.RecordBatch.from_pydict(made, _STRETCH)

    return ordered, stored(joined.mapInArrow(code, _STRETCH_DDL), "stretches")


_STRETCH_DDL = """conv string, stretch long, codes binary, at array<long>, n array<long>, blank long, duplicate long,
  truncated long, illegal long, head int, tail int, costs array<long>"""
_LONGS = pa.list_(pa.int64())
_STRETCH = pa.schema([
    ("conv", pa.string()), ("stretch", pa.int64()), ("codes", pa.binary()), ("at", _LONGS), ("n", _LONGS),
    *((name, pa.int64()) for name in ("blank", "duplicate", "truncated", "illegal")),
    ("head", pa.int32()), ("tail", pa.int32()), ("costs", _LONGS),
])


def _by_conversation(pieces: DataFrame, fn, columns: list[str], added: list[tuple[str, str, pa.DataType]]) -> DataFrame:
    """``fn`` from the ordered small columns of a conversation's stretches to a row for each stretch."""
    gathered = pieces.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("stretch", *columns))).alias("all"))
    schema = pa.schema([("conv", pa.string()), ("stretch", pa.int64()), *((name, kind) for name, _, kind in added)])
    ddl = ", ".join(["conv string, stretch long", *(f"{name} {kind}" for name, kind, _ in added)])

    def run(batches):
        held = []
        for batch in batches:
            for conv, mine in zip(batch.column("conv").to_pylist(), batch.column("all").to_pylist()):
                for s, row in zip(mine, fn(mine)):
                    held.append({"conv": conv, "stretch": s["stretch"], **row})
                    if len(held) == 4096:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held = []
        yield pa.RecordBatch.from_pylist(held, schema)

    return gathered.mapInArrow(run, ddl)


def _ends(mine: list[dict]) -> list[dict]:
    """Costs after each stretch, from the back, and the whole cost at the first."""
    out, v = [], AT_END
    for s in reversed(mine):
        out.append({"after": list(v), "cost": 0, "broken": 0})
        v = through(s["costs"], v)
    out.reverse()
    out[0]["cost"] = v[0]
    for one, two, row in zip(mine, mine[1:], out[1:]):
        row["broken"] = _pairs(np.array([one["tail"], two["head"]]))
    return out


def _entries(mine: list[dict]) -> list[dict]:
    """The state before each stretch."""
    out, state = [], 0
    for s in mine:
        out.append({"state": state, "closes": False})
        state = s["exits"][state]
    out[-1]["closes"] = True
    return out


def planned(pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stretches with faults and cost, and the edits of each ordered row."""
    ends = _by_conversation(
        pieces, _ends, ["costs", "head", "tail"],
        [("after", "array<long>", _LONGS), ("cost", "long", pa.int64()), ("broken", "long", pa.int64())],
    )
    known = pieces.drop("costs", "head", "tail").join(ends, ["conv", "stretch"])

    def exits(batches):
        for batch in batches:
            pairs = zip(batch.column("codes").to_pylist(), batch.column("after").to_pylist())
            out = [[tight_edits(codes, tuple(v), q)[1] if v[q] < NEVER else q for q in range(4)] for codes, v in pairs]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int32()))], [*batch.schema.names, "exits"])

    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in known.schema.fields)
    known = stored(known.mapInArrow(exits, f"{shape}, exits array<int>"), "stretch-ends")
    entries = _by_conversation(known, _entries, ["exits"], [("state", "int", pa.int32()), ("closes", "boolean", pa.bool_())])

    def walk(batches):
        for batch in batches:
            at, made = [], []
            for row in batch.to_pylist():
                edits, state = tight_edits(row["codes"], tuple(row["after"]), row["state"])
                place = 0
                for n in row["n"]:
                    made.append("".join(edits[place : place + n]))
                    place += n
                if row["closes"]:
                    made[-1] += closing(state)
                at += row["at"]
            yield pa.RecordBatch.from_pydict({"at": at, "edits": made}, pa.schema([("at", pa.int64()), ("edits", pa.string())]))

    walked = known.select("conv", "stretch", "codes", "n", "at", "after").join(entries, ["conv", "stretch"])
    return known, walked.mapInArrow(walk, "at long, edits string")


def _streamed(rows: DataFrame, ordered: DataFrame, edits: DataFrame) -> DataFrame:
    """Rows of edits, each before the texts that it is for, by conversation in order."""
    shared = ["conv", "turn", "role", "key"]
    told = ordered.select("at", *shared).join(edits, "at").select(*shared, F.lit(0).alias("tag"), F.col("edits").alias("body"))
    texts = in_order(rows).select(*shared, F.lit(1).alias("tag"), F.col("text").alias("body"))
    both = told.unionByName(texts)
    return both.repartition(parts(rows.sparkSession), "conv").sortWithinPartitions(*ORDER, "tag")


def _events(batches):
    """(conversation, edit, role, text) of each edit in order; (conversation, None, ...) at its end."""
    conv, state, todo, place = None, 0, "", 0

    def inserts():
        nonlocal state, place
        while todo[place : place + 1] == "I":
            state, place = NEXT[state], place + 1
            yield conv, "I", ROLE[state], ""

    for batch in batches:
        for c, role, tag, body in zip(*(batch.column(n).to_pylist() for n in ("conv", "role", "tag", "body"))):
            if c != conv:
                if conv is not None:
                    yield from inserts()
                    yield conv, None, None, None
                conv, state, todo, place = c, 0, "", 0
            if tag == 0:
                todo, place = body, 0
                continue
            yield from inserts()
            edit, place = todo[place], place + 1
            if edit == "K":
                state = {"s": 1, "u": 2, "a": 3}[role[0]]
            elif edit == "R":
                state, role = NEXT[state], ROLE[NEXT[state]]
            yield conv, edit, role, body
    if conv is not None:
        yield from inserts()
        yield conv, None, None, None


def repaired_rows(rows: DataFrame) -> DataFrame:
    """The conversations after repair: conv (``c`` and the id, empty for null), place, edit, role, text."""
    ordered, pieces = stretches(rows)
    _, edits = planned(pieces)
    schema = pa.schema([("conv", pa.string()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])

    def run(batches):
        held, place = [], 0
        for conv, edit, role, text in _events(batches):
            if edit is None:
                place = 0
            elif edit != "D":
                held.append({"conv": conv, "place": place, "edit": edit, "role": role, "text": text})
                place += 1
            if len(held) == 256:
                yield pa.RecordBatch.from_pylist(held, schema)
                held = []
        yield pa.RecordBatch.from_pylist(held, schema)

    return _streamed(rows, ordered, edits).mapInArrow(run, "conv string, place long, edit string, role string, text string")


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation."""
    ordered, pieces = stretches(rows)
    known, edits = planned(pieces)
    schema = pa.schema([("conv", pa.string()), ("audit", pa.large_string()), ("repaired_sha256", pa.string())])

    def run(batches):
        made, audit, sha, lines = [], [], hashlib.sha256(), 0
        for conv, edit, role, text in _events(batches):
            if edit is None:
                made.append({"conv": conv, "audit": "".join(audit), "repaired_sha256": sha.hexdigest()})
                audit, sha, lines = [], hashlib.sha256(), 0
            else:
                audit.append(edit)
                if edit != "D":
                    sha.update(f"{'\n' if lines else ''}{role}:{text}".encode())
                    lines += 1
            if len(made) == 256:
                yield pa.RecordBatch.from_pylist(made, schema)
                made = []
        yield pa.RecordBatch.from_pylist(made, schema)

    digests = _streamed(rows, ordered, edits).mapInArrow(run, "conv string, audit string, repaired_sha256 string")
    faults = known.groupBy("conv").agg(
        *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")),
        F.sum(F.col("illegal") + F.col("broken")).alias("illegal"), F.sum("cost").alias("cost"),
    )
    span = F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")
    gaps = ordered.groupBy("conv").agg(F.coalesce(span, F.lit(0)).cast("long").alias("gaps"))
    ids = rows.select("conv_id", F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("")).alias("conv")).distinct()
    joined = ids.join(gaps, "conv").join(faults, "conv").join(digests, "conv")
    return joined.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
