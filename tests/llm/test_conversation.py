"""Conversation repair against a search over all edits."""
import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from prudent.llm import conversation, queries

SHAPE = re.compile(r"(s?(ua)+)?")
FOLLOWS = {"": "su", "s": "u", "u": "a", "a": "u"}


def brute_damage(rows):
    """conversation -> rows after damage, in order; every conversation is named."""
    out = defaultdict(list)
    for c, t, role, text in rows:
        key = f"{' ' if c is None else c}:{' ' if t is None else t}"
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(key.encode()) % 20
        out[c] += []
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out[c] += [(t, role, text)] * (2 if kind == 3 else 1)
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, v in out.items()}


def brute_repair(rows):
    faults, seen = [], set()
    for _, role, text in rows:
        core = re.sub(r"[\x20\x09-\x0D]+$", "", text)
        fault = "blank" if not core else "duplicate" if (role, text) in seen else "" if core[-1] in ".!?" else "truncated"
        seen.add((role, text))
        faults.append(fault)
    # cheapest first, of equal costs the least edits: the first whole conversation taken from the heap is the answer
    heap = [(0, "", 0, "", ())]
    while True:
        cost, audit, i, last, out = heapq.heappop(heap)
        if i == len(rows) and last in ("", "a"):
            break
        moves = []
        for name in ("user", "assistant"):
            if name[0] in FOLLOWS[last]:
                moves.append((3, "I", 0, name[0], (f"{name}:",)))
                if i < len(rows) and faults[i] not in ("blank", "duplicate"):
                    moves.append((3 + 3 * (faults[i] == "truncated"), "R", 1, name[0], (f"{name}:{rows[i][2]}",)))
        if i < len(rows):
            moves.append((4, "D", 1, last, ()))
            role = rows[i][1]
            if faults[i] not in ("blank", "duplicate") and role and role[0] in FOLLOWS[last]:
                moves.append((3 * (faults[i] == "truncated"), "K", 1, role[0], (f"{role}:{rows[i][2]}",)))
        for c, e, step, now, lines in moves:
            if audit.count("I") + (e == "I") <= 2 * len(rows) + 2:
                heapq.heappush(heap, (cost + c, audit + e, i + step, now, out + lines))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def taken(df):
    assert df.columns == ["conv_id", *conversation.SUMMARY, "audit", "repaired_sha256"]
    return sorted(map(tuple, df.collect()), key=str)


def brute(rows):
    return sorted(((c, *brute_repair(v)) for c, v in brute_damage(rows).items()), key=str)


def random_rows(seed, conversations, turns):
    rng = random.Random(seed)
    rows = []
    for c in range(conversations):
        for t in range(rng.randrange(1, turns)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "Ünknown"])
            text = rng.choice(["Yes.", "no", "Why?", "", None, " \n", "go!\t", "été.", "x y"])
            rows.append((c, rng.choice([t, t, t, t + 3, None, 2]), role, text))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


def test_random_conversations_equal_the_search(spark):
    rows = random_rows(3, 250, 8) + [(None, 0, "user", "Hi."), (None, 1, "assistant", "Ho."), (7000, None, None, None)]
    assert taken(conversation.repair(*damaged(spark.createDataFrame(rows, SCHEMA)))) == brute(rows)


def damaged(df):
    rows = conversation.damage(df.withColumn("seen", F.lit("clash")).withColumn("copy", F.lit(1)).withColumn("conv", F.lit(0)))
    return rows, F.col("lost")


def test_registered_query_equals_the_search(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert taken(queries.QUERIES["op13_conversation_repair"](spark, sf)) == brute(rows)


def test_repaired_turns_have_the_shape_and_the_digest(spark):
    rows, lost = damaged(spark.createDataFrame(random_rows(9, 120, 9), SCHEMA))
    plans = conversation.repair(rows, lost)
    expected = {r.conv_id: r for r in plans.collect()}
    got = defaultdict(list)
    for r in conversation.apply_edits(rows, plans, lost).orderBy("conv_id", "position").collect():
        got[r.conv_id].append(r)
    for c, plan in expected.items():
        turns = got[c]
        assert [r.position for r in turns] == list(range(len(turns)))
        assert SHAPE.fullmatch("".join(r.role[0] for r in turns))
        assert "".join(r.edit for r in turns) == plan.audit.replace("D", "")
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in turns).encode()).hexdigest() == plan.repaired_sha256


def test_a_giant_conversation_over_batches_and_scratch_space(spark):
    """One conversation over many Arrow batches and blocks of the way back gives what whole lists give."""
    batches = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    rng = random.Random(4)
    rows = [(1, t, rng.choice(["user", "assistant"]), f"{rng.randrange(9000)} " + rng.choice([".", "", "!"])) for t in range(12_000)]
    rows += [(0, 0, "user", "Hi."), (2, 0, "user", "Hi.")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    old, conversation.SPILL_ROWS = conversation.SPILL_ROWS, 1 << 20
    try:
        got = {r.conv_id: r for r in conversation.repair(spark.createDataFrame(rows, SCHEMA)).collect()}
    finally:
        conversation.SPILL_ROWS = old
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batches)
    one = conversation._Conversation("1")
    conversation_rows = sorted(r for r in rows if r[0] == 1)
    seen = set()
    spill, conversation.SPILL_ROWS = conversation.SPILL_ROWS, 64
    try:
        for _, turn, role, text in conversation_rows:
            one.take(str(turn), role, text, (role, text) in seen)
            seen.add((role, text))
        result = one.result()
    finally:
        conversation.SPILL_ROWS = spill
    assert result[1:] == tuple(got[1])[1:]
    assert len(got) == 3 and got[0].audit == got[2].audit == "KI"
    # cost of the edits is the cost of the audit, replayed by another automaton
    assert got[1].cost == replay_cost(got[1].audit, conversation_rows)


def replay_cost(audit, rows):
    cost, at, last, seen = 0, 0, "", set()
    for e in audit:
        if e == "I":
            last, cost = ("a" if last == "u" else "u"), cost + 3
            continue
        _, _, role, text = rows[at]
        at += 1
        gone = not text.strip() or (role, text) in seen
        seen.add((role, text))
        if e == "D":
            cost += 4
            continue
        assert not gone
        cost += 3 * (text.rstrip()[-1] not in ".!?") + 3 * (e == "R")
        last = role[0] if e == "K" else ("a" if last == "u" else "u")
    assert at == len(rows) and last in ("", "a")
    return cost


def test_empty_and_lost(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert taken(conversation.repair(empty)) == []
    assert conversation.apply_edits(empty, conversation.repair(empty)).collect() == []
    gone = conversation.repair(spark.createDataFrame([(5, 0, "user", "Hi.")], SCHEMA), F.lit(True)).collect()
    assert [tuple(r) for r in gone] == [(5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


@pytest.mark.parametrize("roles,audit", [("ua", "KK"), ("su", "KKI"), ("s", "D"), ("a", "IK"), ("au", "DD"), ("uu", "KIKI"), ("sua", "KKK"), ("usa", "KDK")])
def test_small_shapes(roles, audit):
    names = {"s": "system", "u": "user", "a": "assistant"}
    rows = [(t, names[r], f"Turn {t}.") for t, r in enumerate(roles)]
    one = conversation._Conversation("x")
    for t, role, text in rows:
        one.take(str(t), role, text, False)
    got = one.result()
    expected = brute_repair(rows)
    assert got[1:] == expected
    if roles in ("ua", "su", "a", "sua", "usa"):
        assert got[7] == audit
