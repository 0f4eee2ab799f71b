"""Conversation structure repair: the cheapest edits that make a conversation well formed.

Role initials of a repaired conversation are ``(s?(ua)+)?``: perhaps a system turn, then pairs of user
and assistant turns, or nothing.  Rows are dealt by conversation and sorted by turn, and a task reads
them as one stream over its Arrow batches.  A dynamic program over the four places in that pattern
goes along with the stream: per place the cost of the best edits so far, their rank in ASCII order
among the places' best, a running SHA-256 of the repaired text, and the way back.  Costs relative to
the cheapest place, ranks and the next row's kind take few values, so each transition is worked out
once and the way back is two bytes a row, written to scratch space in long conversations.  A task's
memory does not depend on the length of a conversation, but for its edits, a letter a row.
"""

from __future__ import annotations

import hashlib
import tempfile
from array import array
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
_SPACE = " \t\n\x0b\x0c\r"
#: places in the pattern: nothing yet, after the system turn, after a user turn, after an assistant turn (complete)
START, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: the initial and place that an inserted or rerouted turn takes
_FILL = {START: ("u", USER), SYSTEM: ("u", USER), USER: ("a", ASSISTANT), ASSISTANT: ("u", USER)}
_ROLE = {"u": "user", "a": "assistant"}
#: rows of a way back kept in memory
SPILL_ROWS = 1 << 20
SUMMARY = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


class Layer(NamedTuple):
    """Cost of each place above the cheapest (None: out of reach) and its rank in ASCII order of edits."""
    cost: tuple[int | None, ...]
    rank: tuple[int | None, ...]


FIRST = Layer((0, None, None, None), (0, None, None, None))
#: (layer, initial or "" for a row that must go, truncated) -> (layer after, cost added, number of the moves)
_KNOWN: dict[tuple, tuple[Layer, int, int]] = {}
#: per number: for each place reached (place before, edits)
_MOVES: list[tuple[tuple[int, str] | None, ...]] = []


def _inserted(layer: Layer) -> Iterator[tuple[int, int, int, int, str]]:
    """Places within reach without taking a row: cost, rank, place before, place, edits."""
    for before in range(4):
        cost, rank = layer.cost[before], layer.rank[before]
        if cost is None:
            continue
        place, edits = before, ""
        for _ in range(3):
            yield cost, rank, before, place, edits
            place, edits, cost = _FILL[place][1], edits + "I", cost + INSERT


def _step(layer: Layer, initial: str, truncated: bool) -> tuple[Layer, int, int]:
    key = (layer, initial, truncated)
    if key not in _KNOWN:
        best: dict[int, tuple[int, int, str, int]] = {}

        def offer(to: int, cost: int, rank: int, edits: str, before: int) -> None:
            # of equal costs the least edits in ASCII order: no place's edits begin with another's, so their rank decides
            found = (cost, rank, edits, before)
            best[to] = min(best.get(to, found), found)

        extra = TRUNCATED if truncated else 0
        for cost, rank, before, place, edits in _inserted(layer):
            offer(place, cost + DELETE, rank, edits + "D", before)
            if initial:
                if (place, initial) in _NEXT:
                    offer(_NEXT[place, initial], cost + KEEP + extra, rank, edits + "K", before)
                offer(_FILL[place][1], cost + REROLE + extra, rank, edits + "R", before)
        least = min(b[0] for b in best.values())
        order = sorted(best, key=lambda q: best[q][1:3])
        after = Layer(tuple(best[q][0] - least if q in best else None for q in range(4)),
                      tuple(order.index(q) if q in best else None for q in range(4)))
        _MOVES.append(tuple((best[q][3], best[q][2]) if q in best else None for q in range(4)))
        _KNOWN[key] = (after, least, len(_MOVES) - 1)
    return _KNOWN[key]


def _emit(place: int, edits: str, initial: str, role: str) -> Iterator[tuple[str, str, bool]]:
    """``(edit, role, is the row itself)`` of the turns that the edits give, from a place on."""
    for e in edits:
        if e in "IR":
            fill, place = _FILL[place]
            yield e, _ROLE[fill], e == "R"
        elif e == "K":
            place = _NEXT[place, initial]
            yield e, role, True


class _Trail:
    """Numbers of the moves, row by row, beyond ``SPILL_ROWS`` in scratch space; read backwards."""

    def __init__(self):
        self.near, self.file = array("H"), None

    def add(self, number: int) -> None:
        self.near.append(number)
        if len(self.near) >= SPILL_ROWS:
            self.file = self.file or tempfile.TemporaryFile()
            self.near.tofile(self.file)
            self.near = array("H")

    def backwards(self) -> Iterator[int]:
        yield from reversed(self.near)
        at = self.file.tell() if self.file else 0
        while at:
            block = array("H")
            at -= SPILL_ROWS * block.itemsize
            self.file.seek(at)
            block.fromfile(self.file, SPILL_ROWS)
            yield from reversed(block)
        if self.file:
            self.file.close()


class _Conversation:
    """What is carried from row to row, and from batch to batch."""

    def __init__(self, name: str | None):
        self.name = name
        self.layer, self.cost, self.trail = FIRST, 0, _Trail()
        self.digest: list = [hashlib.sha256(), None, None, None]
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.low = self.high = None
        self.turns = 0
        self.initial: str | None = None

    def take(self, turn: str | None, role: str, text: str, seen: bool) -> None:
        if turn is not None:
            number = int(turn)
            if number != self.high:  # turns come in order
                self.turns += 1
            self.low = number if self.low is None else self.low
            self.high = number
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = initial
        core = text.rstrip(_SPACE)
        blank, cut = not core, bool(core) and core[-1] not in ".!?"
        fault = "blank" if blank else "duplicate" if seen else "truncated" if cut else None
        if fault:
            setattr(self, fault, getattr(self, fault) + 1)
        # a row that must go has no initial here; a role without one can be rerouted but not kept
        initial = "" if blank or seen else initial if initial in ("s", "u", "a") else "?"
        self.layer, added, number = _step(self.layer, initial, fault == "truncated")
        self.cost += added
        self.trail.add(number)
        body, digests = text.encode("utf-8", "surrogatepass"), []
        for move in _MOVES[number]:
            digests.append(None if move is None else _hashed(self.digest[move[0]], move[0], move[1], initial, role, body))
        self.digest = digests

    def result(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        ends = [(cost, rank, edits, before) for cost, rank, before, place, edits in _inserted(self.layer)
                if place == ASSISTANT or (place == START and not edits)]
        cost, _, edits, place = min(ends)
        digest = _hashed(self.digest[place], place, edits, "", "", b"")
        parts = [edits]
        for number in self.trail.backwards():
            place, edits = _MOVES[number][place]
            parts.append(edits)
        return (self.name, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost + cost,
                "".join(reversed(parts)), digest.hexdigest())


def _hashed(digest, place: int, edits: str, initial: str, role: str, body: bytes):
    out = digest.copy()
    started = place != START
    for _, name, itself in _emit(place, edits, initial, role):
        out.update(b"\n" * started + name.encode("utf-8", "surrogatepass") + b":")
        if itself:
            out.update(body)
        started = True
    return out


def _plan(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["conv", *SUMMARY, "audit", "repaired_sha256"]
    current: _Conversation | None = None
    for batch in batches:
        done = []
        for conv, turn, role, text, lost, seen in zip(*(batch[c].tolist() for c in ("conv", "turn", "role", "text", "lost", "seen"))):
            if current is None or conv != current.name:
                if current:
                    done.append(current.result())
                current = _Conversation(conv)
            if not lost:
                current.take(turn, role, text, seen)
        yield pd.DataFrame(done, columns=names)
    if current:
        yield pd.DataFrame([current.result()], columns=names)


def _base(rows: DataFrame, lost: Column | None) -> DataFrame:
    return rows.select(F.col("conv_id").cast("string").alias("conv"), F.col("turn").cast("long").alias("turn"),
                       F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
                       F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
                       (F.lit(False) if lost is None else F.coalesce(lost, F.lit(False))).alias("lost"))


def _order() -> list[Column]:
    return [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]


def repair(rows: DataFrame, lost: Column | None = None) -> DataFrame:
    """Faults, cheapest edits and digest of the repaired text of every conversation.

    ``rows`` has ``conv_id, turn, role, text``; a row for which ``lost`` is true only names its
    conversation.  Returns ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256``: ``audit`` is a letter an edit (Keep, Rerole, Delete, Insert) in order, the
    least in ASCII order among the cheapest; ``apply_edits`` gives the repaired turns themselves.

    One conversation is read by one task, as a sorted stream; shuffle and sorts spill.  Rows are
    shuffled once: the mark of rows seen earlier is a window within the same partitions.

    Cases: a null role or text counts as one space (such a text is blank); a null turn comes first; rows
    of one turn are ordered by role and text; a role that begins with none of s, u, a can't be kept;
    repeated rows are duplicates; null ids form one conversation; a conversation whose rows are all
    lost has zeros, no edits and the digest of nothing; other columns are not read, whatever their
    names; an empty table gives an empty result.
    """
    kind = rows.schema["conv_id"].dataType
    parted = _base(rows, lost).repartition("conv")
    seen = Window.partitionBy("conv", "lost", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    marked = parted.withColumn("seen", F.row_number().over(seen) > 1)
    # as text: a column with nulls would come as floating-point numbers
    stream = marked.sortWithinPartitions(*_order()).withColumn("turn", F.col("turn").cast("string"))
    schema = "conv string, " + ", ".join(f"{c} long" for c in SUMMARY) + ", audit string, repaired_sha256 string"
    return (stream.mapInPandas(_plan, schema)
            .select(F.col("conv").cast(kind).alias("conv_id"), *SUMMARY, "audit", "repaired_sha256"))


def _apply(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["conv", "position", "edit", "turn", "role", "text"]
    conv, audit, at, place, position, started = None, "", 0, START, 0, False

    def follow(stop: str, initial: str, role: str, text: str, turn: str | None) -> Iterator[tuple]:
        """Turns of the next edits up to one in ``stop``, or to the end."""
        nonlocal at, place, position
        end = at
        while end < len(audit) and audit[end] == "I":
            end += 1
        end += bool(stop) and end < len(audit)
        for e, name, itself in _emit(place, audit[at:end], initial, role):
            place = _FILL[place][1] if e in "IR" else _NEXT[place, initial]
            yield conv, position, e, turn if itself else None, name, text if itself else ""
            position += 1
        at = end

    for batch in batches:
        out: list[tuple] = []
        for name, turn, role, text, head in zip(*(batch[c].tolist() for c in ("conv", "turn", "role", "text", "head"))):
            if head:  # the conversation's edits stand before its rows
                if started:
                    out += follow("", "", "", "", None)
                conv, audit, at, place, position, started = name, text, 0, START, 0, True
            else:
                out += follow("KRD", role[:1], role, text, turn)
        yield pd.DataFrame(out, columns=names)
    if started:
        yield pd.DataFrame(list(follow("", "", "", "", None)), columns=names)


def apply_edits(rows: DataFrame, plans: DataFrame, lost: Column | None = None) -> DataFrame:
    """The repaired turns: ``conv_id, position, edit, turn, role, text`` (an inserted turn has no turn and an empty text).

    ``plans`` is the result of ``repair`` on the same rows.  Its edits are sorted before the rows of
    their conversation and followed row by row.  Cases are those of ``repair``.
    """
    kind = rows.schema["conv_id"].dataType
    heads = plans.select(F.col("conv_id").cast("string").alias("conv"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"),
                         F.col("audit").alias("text"), F.lit(True).alias("head"))
    body = _base(rows, lost).where("NOT lost").drop("lost").withColumn("head", F.lit(False))
    order = _order()
    stream = heads.unionByName(body).repartition("conv").sortWithinPartitions(order[0], F.col("head").desc(), *order[1:])
    return (stream.withColumn("turn", F.col("turn").cast("string"))
            .mapInPandas(_apply, "conv string, position long, edit string, turn string, role string, text string")
            .select(F.col("conv").cast(kind).alias("conv_id"), "position", "edit", F.col("turn").cast("long").alias("turn"), "role", "text"))


def damage(rows: DataFrame) -> DataFrame:
    """Rows with the planted damage, told by ``crc32(conv_id:turn) % 20`` (nulls: one space).

    0 loses the row (``lost``), 1 empties its text, 2 takes its ``[.!?]`` away, 3 repeats it, 4 makes its
    role user.  An empty table gives an empty result; other columns go.
    """
    part = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    kind = F.crc32(F.concat(part[0], F.lit(":"), part[1]).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(part[3], "[.!?]", "")).otherwise(part[3])
    return (rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(part[2]).alias("role"), text.alias("text"), (kind == 0).alias("lost"),
                        F.when(kind == 3, F.sequence(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("copies"))
            .withColumn("copy", F.explode("copies")).drop("copies", "copy"))
