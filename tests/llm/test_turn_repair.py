import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from fixatlas.llm import turn_repair as tr
from fixatlas.llm.queries import QUERIES, damaged

PATTERN = re.compile(r"(s?(ua)+)?")
SHAPE = "conv_id long, turn long, role string, text string"


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """Least cost and ASCII-least audit, by trying all edits in the order of cost and audit."""
    found, done = faults(rows), set()
    todo = [(0, "", 0, "", "")]
    while True:
        cost, audit, i, roles, repaired = heapq.heappop(todo)
        tail = roles[-1:]
        if (i, tail) in done:
            continue
        done.add((i, tail))
        if i == len(rows) and tail in ("", "a"):
            assert PATTERN.fullmatch(roles)
            return cost, audit, repaired.removesuffix("\n")
        put = {"": "u", "s": "u", "u": "a", "a": "u"}[tail]
        name = {"u": "user", "a": "assistant"}[put]
        heapq.heappush(todo, (cost + 3, audit + "I", i, roles + put, f"{repaired}{name}:\n"))
        if i == len(rows):
            continue
        (role, text), fault = rows[i], found[i]
        heapq.heappush(todo, (cost + 4, audit + "D", i + 1, roles, repaired))
        if fault in ("blank", "duplicate"):
            continue
        more = 3 if fault else 0
        heapq.heappush(todo, (cost + 3 + more, audit + "R", i + 1, roles + put, f"{repaired}{name}:{text}\n"))
        if role[:1] == put or (role[:1] == "s" and not roles):
            heapq.heappush(todo, (cost + more, audit + "K", i + 1, roles + role[0], f"{repaired}{role}:{text}\n"))


def slow(rows):
    """conv_id -> the report, from rows (conv_id, turn, role, text)."""
    groups = {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, []).append((turn is not None, turn or 0, role if role is not None else " ", text if text is not None else " "))
    out = {}
    for conv, mine in groups.items():
        sha = lambda r: hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest()
        mine.sort(key=lambda r: (r[0], r[1], r[2].encode(), sha(r)))
        turns = [t for known, t, _, _ in mine if known]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        pairs = [r[2:] for r in mine]
        found = faults(pairs)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(pairs, pairs[1:]))
        cost, audit, repaired = cheapest(pairs)
        out[conv] = (gaps, *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(repaired.encode()).hexdigest())
    return out


def fast(df):
    return {r[0]: tuple(r[1:]) for r in tr.repair(df).collect()}


def conversations(seed, n, most):
    r = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "and so", "…", "", " \t", None, "é.\n", "ok. \x0b", "so", "Fine."]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "s", "usher", "a"]
    rows = []
    for conv in range(n):
        for turn in range(r.randint(1, most)):
            t = r.choice([turn, turn, turn, turn + 3, None])
            rows.append((conv if conv else None, t, r.choice(roles), r.choice(texts)))
            if r.random() < 0.2:
                rows += [rows[-1]] * r.randint(1, 3)
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_checkpoints_give_the_least_audit(seed):
    r = random.Random(seed)
    for _ in range(300):
        rows = [(r.choice(["system", "user", "assistant", "tool"]), r.choice(["a.", "b.", "c", "", f"{r.random()}."])) for _ in range(r.randint(0, 14))]
        found = faults(rows)
        seen = {"s": 1, "u": 2, "a": 3}
        codes = bytes(seen.get(role[0], 0) | (8 if f in ("blank", "duplicate") else 4 if f else 0) for (role, _), f in zip(rows, found))
        edits, state = tr.tight_edits(codes, tr.AT_END, 0)
        cost, audit, _ = cheapest(rows)
        assert "".join(edits) + tr.closing(state) == audit
        assert tr.costs_before(codes, tr.AT_END)[0] == cost == tr.through(tr.table(codes), tr.AT_END)[0]


def test_against_brute_force(spark):
    rows = conversations(3, 60, 12)
    assert fast(spark.createDataFrame(rows, SHAPE).repartition(5)) == slow(rows)


def test_a_conversation_over_many_stretches(spark):
    r = random.Random(9)
    rows = [(7, t, r.choice(["user", "assistant", "assistant", "system"]), r.choice(["x.", f"{t}.", f"{t}", " "])) for t in range(3000)]
    rows += [(8, 0, "user", "Hi.")] + [(9, 1, "user", "same.")] * 500
    df = spark.createDataFrame(rows, SHAPE).repartition(6)
    _, pieces = tr.stretches(df)
    assert pieces.where("conv = 'c7'").count() > 40
    assert fast(df) == slow(rows)


def test_repaired_rows_follow_the_pattern(spark):
    rows = conversations(11, 30, 9)
    made = {}
    for r in tr.repaired_rows(spark.createDataFrame(rows, SHAPE)).orderBy("conv", "place").collect():
        made.setdefault(r.conv, []).append(r)
    assert all(PATTERN.fullmatch("".join(r.role[0] for r in m)) for m in made.values())
    assert all([r.place for r in m] == list(range(len(m))) for m in made.values())


def test_empty_table_and_other_columns(spark):
    assert tr.repair(spark.createDataFrame([], SHAPE)).count() == 0
    df = spark.createDataFrame([(1, 0, "user", "Hi.", "x", 1)], f"{SHAPE}, conv string, at int")
    assert fast(df) == {1: (0, 0, 0, 0, 0, 3, "KI", hashlib.sha256(b"user:Hi.\nassistant:").hexdigest())}


def broken(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        role = "user" if kind == 4 else role
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def test_query_against_brute_force(spark):
    where = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{where}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    hurt = broken(rows)
    assert sorted(hurt) == sorted(tuple(r) for r in damaged(spark.createDataFrame(rows, SHAPE)).collect())
    want = slow(hurt)
    none = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    found = {r[0]: tuple(r[1:]) for r in QUERIES["op13_turn_repair"](spark, where).collect()}
    assert found == {conv: want.get(conv, none) for conv, *_ in rows}


def test_conversations_of_which_nothing_is_left(spark, tmp_path):
    lost = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(lost, 0, "user", "Hi."), (None, None, None, None)], SHAPE)
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    found = {r.conv_id: r for r in QUERIES["op13_turn_repair"](spark, str(tmp_path)).collect()}
    assert found[lost].audit == "" and found[lost].cost == 0
    assert found[None].blank == 1 and found[None].audit == "D" and found[None].cost == 4
