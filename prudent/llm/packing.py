"""Best-fit packing of tokenised documents into fixed-length sequences by linear grouping.

Lengths are integers up to the capacity, so their histogram (at most ``capacity`` rows, whatever
the corpus) is the whole packing problem.  The driver plans on it:

1.  large lengths, sorted, are cut into groups of equal cardinality and rounded up to the group's
    largest length;
2.  a linear program over configurations of these few sizes is solved by column generation (pricing
    is a knapsack over the capacity), and rounded down;
3.  actual lengths replace the rounded ones, so a configuration has more room than it said;
4.  what rounding left over, and then the small lengths, go best-fit into the rooms that are left.

The plan is a list of patterns, each an exact list of lengths with a multiplicity; its size depends
on the capacity and the number of groups, not on the corpus.  Spark ranks the pieces within their
length and looks up their place in the plan.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prudent.llm.common import staged
from prudent.llm.tokens import encoder as shared_encoder
from prudent.llm.tokens import vocabulary_path

CAPACITY, END_ID, GROUPS, SMALL = 1024, 2, 128, 3
#: pieces that are ranked in one window
RANKED = 100_000


def _knapsack(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of highest value (items may repeat) that fits the capacity."""
    best, take = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(int(sizes.min()), capacity + 1):
        fits = np.flatnonzero(sizes <= room)
        gain = best[room - sizes[fits]] + values[fits]
        top = int(gain.argmax())
        best[room] = best[room - 1]
        if gain[top] > best[room] + 1e-12:
            best[room], take[room] = gain[top], fits[top]
    count, room = np.zeros(len(sizes)), capacity
    while room > 0:
        if take[room] < 0:
            room -= 1
            continue
        count[take[room]] += 1
        room -= int(sizes[take[room]])
    return float(best[capacity]), count


def _configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[int, np.ndarray]]:
    """Fractional optimum of the configuration program by column generation, rounded down."""
    k = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    x = demand / basis.diagonal()
    for _ in range(50 * k):  # it ends when no configuration prices out; a bound against cycling only
        duals = np.linalg.solve(basis.T, np.ones(k))
        value, column = _knapsack(np.maximum(duals, 0), sizes, capacity)
        if value <= 1 + 1e-7:
            break
        direction = np.linalg.solve(basis, column)
        ratio = np.where(direction > 1e-9, x / np.where(direction > 1e-9, direction, 1), np.inf)
        out = int(ratio.argmin())
        x = x - ratio[out] * direction
        x[out] = ratio[out]
        x = np.maximum(x, 0)
        basis[:, out] = column
    return [(int(m + 1e-9), basis[:, j].astype(int)) for j, m in enumerate(x) if m >= 1 - 1e-9]


def _group_sizes(counts: dict[int, int], groups: int) -> dict[int, int]:
    """Lengths in descending order cut into groups of equal cardinality: largest length of a group -> pieces."""
    share = -(-sum(counts.values()) // groups)
    out: dict[int, int] = {}
    room = size = 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if not room:
                size, room = length, share
            n = min(left, room)
            out[size] = out.get(size, 0) + n  # groups that round up to one length are one size
            left, room = left - n, room - n
    return out


class _Rooms:
    """Patterns by the room that they leave: room -> list of [multiplicity, lengths]."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.by_room: list[list[list]] = [[] for _ in range(capacity + 1)]

    def put(self, n: int, lengths: list[int]) -> None:
        if n:
            self.by_room[self.capacity - sum(lengths)].append([n, lengths])

    def best_fit(self, length: int, n: int) -> None:
        """Place ``n`` pieces of one length, each into the least room that holds it, else a new sequence."""
        for room in range(length, self.capacity + 1):
            while n and self.by_room[room]:
                have, lengths = self.by_room[room].pop()
                fits = room // length  # the same length goes on fitting there until the room is used up
                full = min(have, n // fits)
                self.put(full, lengths + [length] * fits)
                have, n = have - full, n - full * fits
                if have and n:
                    self.put(1, lengths + [length] * n)
                    have, n = have - 1, 0
                if have:
                    self.by_room[room].append([have, lengths])
        if n:
            fits = self.capacity // length
            self.put(n // fits, [length] * fits)
            self.put(min(1, n % fits), [length] * (n % fits))


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: int = SMALL) -> list[tuple[int, list[int]]]:
    """Patterns (multiplicity, lengths) that pack ``counts[length]`` pieces of every length."""
    rooms = _Rooms(capacity)
    rest = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        rest[length] = n
    least = capacity // small + 1
    large = {length: n for length, n in counts.items() if length >= least}
    if large:
        sized = _group_sizes(large, groups)
        sizes = np.array(sorted(sized, reverse=True))
        for m, config in _configurations(sizes, np.array([sized[s] for s in sizes], float), capacity):
            slots = [int(sizes[g]) for g, c in enumerate(config) for _ in range(c)]
            while m and slots:
                # longest actual lengths in place of the rounded ones; the last slot takes all the room that is left
                taken: list[int] = []
                for i, size in enumerate(slots):
                    limit = size if i < len(slots) - 1 else capacity - sum(taken)
                    fits = np.flatnonzero(rest[least:limit + 1])
                    if len(fits):
                        taken.append(least + int(fits[-1]))
                        rest[taken[-1]] -= 1
                if not taken:
                    break
                step = 1 + min([m - 1, *(int(rest[x]) // taken.count(x) for x in taken)])
                for x in taken:
                    rest[x] -= step - 1
                rooms.put(step, taken)
                m -= step
    for length in np.flatnonzero(rest)[::-1].tolist():
        rooms.best_fit(length, int(rest[length]))
    merged_patterns: dict[tuple, int] = {}
    for entry in rooms.by_room:
        for n, lengths in entry:
            key = tuple(sorted(lengths, reverse=True))
            merged_patterns[key] = merged_patterns.get(key, 0) + n
    return [(n, list(lengths)) for lengths, n in sorted(merged_patterns.items())]


def places(patterns: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, rank after the last, first sequence, offset) of a plan."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for n, lengths in patterns:
        offset = 0
        for length in lengths:
            at = used.get(length, 0)
            rows.append((length, at, at + n, base, offset))
            used[length] = at + n
            offset += length
        base += n
    return rows


def _cut(path: str, capacity: int, end_id: int, with_ids: bool):
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.binary())] * with_ids)

    def run(batches):
        encoder = shared_encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                names = batch.column(0).slice(at, 512).to_pylist()
                rows = []
                for name, ids in zip(names, encoder.encode_batch(batch.column(1).slice(at, 512).to_pylist(), end_id=end_id)):
                    first = (len(ids) - 1) % capacity + 1
                    ends = range(first, len(ids) + 1, capacity)
                    for p, end in enumerate(ends):
                        start = max(0, end - capacity) if p else 0
                        data = ids[start:end].tobytes()
                        rows.append((name, p, start, end - start, zlib.crc32(data)) + (data,) * with_ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
    return run


def cut_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
               capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Tokenised pieces of every document; only one of more than ``capacity`` ids is cut, its first piece may be shorter."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(_cut(tokenizer or vocabulary_path(), capacity, end_id, with_ids),
                           "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def pack(pieces: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces (``doc_id, piece, start, length, ids_crc32``, at most ``capacity`` long).

    Ranks within a length come from windows of about ``RANKED`` pieces plus the counts before them.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # <= capacity rows
    if counts and not 0 < min(counts) <= max(counts) <= capacity:
        raise ValueError("pieces must have 1 to capacity ids")
    where = F.broadcast(spark.createDataFrame(places(plan(counts, capacity, groups)), "len long, lo long, hi long, base long, offset long"))
    shards = F.broadcast(spark.createDataFrame([(k, 1 + n // RANKED) for k, n in counts.items()], "slen long, shards long"))
    dealt = (pieces.join(shards, F.col("length") == F.col("slen"))
             .withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.col("shards"))).drop("slen", "shards"))
    per = dealt.groupBy("length", "shard").agg(F.count("*").alias("n"))
    before = per.select(F.col("length").alias("blen"), F.col("shard").alias("bshard"),
                        F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("shard")
                                                   .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    order = Window.partitionBy("length", "shard").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = (dealt.withColumn("rank", F.row_number().over(order) - 1)
              .join(before, (F.col("length") == F.col("blen")) & (F.col("shard") == F.col("bshard")))
              .withColumn("rank", F.col("rank") + F.col("before")))
    return (ranked.join(where, (F.col("length") == F.col("len")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
            .withColumn("sequence_id", F.col("base") + F.col("rank") - F.col("lo"))
            .select(*pieces.columns, "sequence_id", "offset"))


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
                   capacity: int = CAPACITY, end_id: int = END_ID, groups: int = GROUPS) -> DataFrame:
    """Pack the tokens of all documents into sequences of at most ``capacity`` ids.

    Returns per piece ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Cases: a null or empty text is the end id alone; a null id is kept as null; repeated rows are
    packed each; ties in length are broken by id, piece and checksum; other columns are ignored; an
    empty table gives an empty result.
    """
    return pack(staged(cut_pieces(docs, id_col, text_col, tokenizer, capacity, end_id), "pieces"), capacity, groups)


def packed_sequences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
                     capacity: int = CAPACITY, end_id: int = END_ID, groups: int = GROUPS) -> DataFrame:
    """The sequences themselves: ``sequence_id, n_tokens, parts`` (offset, doc_id, ids as little-endian 32-bit integers), by offset."""
    placed = pack(staged(cut_pieces(docs, id_col, text_col, tokenizer, capacity, end_id, with_ids=True), "pieces-ids"), capacity, groups)
    return placed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"),
                                             F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("parts"))
