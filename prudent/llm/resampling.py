"""Importance resampling of documents towards a target distribution, by bit-sliced sums.

A text's features are its runs of one to two words, hashed into buckets (CRC-32).  The histogram of
the whole corpus and that of the target texts give every bucket a gain, the scaled logarithm of the
ratio of its smoothed frequencies.  A document's counts become bit planes, one bit a bucket: bit i
of bucket b's count stands in plane i.  Gains are planes too, of their magnitudes, apart by sign.
The sum of gains over a document is then ``sum 2**(i + j) * popcount(counts_i AND gains_j)``, whole
numbers throughout, so weights are exact and the same on any partitioning.

Only the two histograms (``buckets`` rows each) and the histogram of the scores reach the driver.
Scores are whole numbers between proven bounds (``MAX_SCORES``), so that doesn't grow with the rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prudent.llm.common import staged

BUCKETS, SHARE, SEED, MIN_WORDS = 10_000, 25, 7, 20
#: a gain is at most 1000 * ln(2**128) in magnitude, the hashed part lies between -3,122 and 22,875
MAX_SCORES = 2 * 88_723 + 3_122 + 22_875 + 1
#: bytes of text taken at once, and rows whose counts are spread over all buckets at once
CHUNK, ROWS = 1 << 22, 128
#: words up to this length are hashed side by side, longer ones one by one
SIDE_BY_SIDE = 48

_SPACE, _LETTER_CASE = 0x20, 0x20
#: byte -> lower-cased byte of a word, or 0 for a byte between words
_WORD_BYTES = np.array([b + _LETTER_CASE if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0
                        for b in range(256)], np.uint8)


def _crc_table() -> np.ndarray:
    """The register after one byte, for every low byte of the register."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_STEP = _crc_table()


def _shift_table(longest: int) -> np.ndarray:
    """``[n, k, b]``: what byte k of value b of a checksum becomes when n bytes follow (checksums are linear)."""
    out = np.zeros((longest + 1, 4, 256), np.uint32)
    for k in range(4):
        out[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for n in range(1, longest + 1):
        out[n] = (out[n - 1] >> np.uint32(8)) ^ _STEP[out[n - 1] & np.uint32(255)]
    return out


_SHIFT = _shift_table(SIDE_BY_SIDE + 1)


def _shifted(crc: np.ndarray, following: np.ndarray) -> np.ndarray:
    """A prefix's part in the checksum of the whole, ``following`` bytes later."""
    out = np.zeros(len(crc), np.uint32)
    for k in range(4):
        out ^= _SHIFT[following, k, (crc >> np.uint32(8 * k)) & np.uint32(255)]
    return out


def _checksums(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """CRC-32 of every word, and of every word with a space before it."""
    plain = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    spaced = _STEP[(plain ^ np.uint32(_SPACE)) & np.uint32(255)] ^ (plain >> np.uint32(8))
    order = np.argsort(sizes, kind="stable")
    by_size = sizes[order]
    for at in range(min(int(by_size[-1]), SIDE_BY_SIDE) if len(order) else 0):
        i = order[np.searchsorted(by_size, at, "right"):np.searchsorted(by_size, SIDE_BY_SIDE, "right")]
        byte = data[starts[i] + at]
        for crc in (plain, spaced):
            c = crc[i]
            crc[i] = _STEP[(c ^ byte) & np.uint32(255)] ^ (c >> np.uint32(8))
    plain, spaced = ~plain, ~spaced
    for i in order[np.searchsorted(by_size, SIDE_BY_SIDE, "right"):].tolist():
        word = data[starts[i]:starts[i] + sizes[i]].tobytes()
        plain[i], spaced[i] = zlib.crc32(word), zlib.crc32(b" " + word)
    return plain, spaced


def features(data: np.ndarray, ends: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts that stand one after another in ``data`` (lower-cased word bytes, 0 between words) and end at ``ends``.

    Returns the text number and the checksum of every word, and the bucket of every word with its
    follower (-1 where none follows in the same text).
    """
    inside = data > 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = ends[:-1][ends[:-1] < len(data)]
    first[begins] = inside[begins]  # a text's first byte begins a word whatever stands before it
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last)
    sizes = stops - starts + 1
    owner = np.searchsorted(ends, starts, "right")
    plain, spaced = _checksums(data, starts, sizes)
    pairs = np.full(len(starts), -1, np.int64)
    if len(starts) > 1:
        joined = np.flatnonzero(owner[1:] == owner[:-1])
        fits = sizes[joined + 1] <= SIDE_BY_SIDE
        short = joined[fits]
        pairs[short] = (_shifted(plain[short], sizes[short + 1] + 1) ^ spaced[short + 1]) % np.uint32(buckets)
        for i in joined[~fits].tolist():
            pairs[i] = _follower(int(plain[i]), data[starts[i + 1]:stops[i + 1] + 1]) % buckets
    return owner, plain, pairs


def _follower(crc: int, word: np.ndarray) -> int:
    """Checksum of a word, a space and the next word from that of the first."""
    return zlib.crc32(b" " + word.tobytes(), crc)


def _slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about ``CHUNK`` bytes: first row, rows, word bytes, ends.  One longer text stands alone, raw."""
    if not len(texts):
        return
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        stop = int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1
        stop = min(max(stop, at + 1), len(texts))
        raw = data[offsets[at]:offsets[stop]]
        yield at, stop - at, raw if len(raw) > CHUNK else _WORD_BYTES[raw], offsets[at + 1:stop + 1] - offsets[at]
        at = stop


def _pieces(raw: np.ndarray) -> Iterator[np.ndarray]:
    """Word bytes of a long text, piece by piece, each cut after a whole word."""
    at = 0
    while at < len(raw):
        stop = min(at + CHUNK, len(raw))
        while stop < len(raw) and _WORD_BYTES[raw[stop]]:
            gap = np.flatnonzero(_WORD_BYTES[raw[stop:stop + CHUNK]] == 0)
            stop = stop + int(gap[0]) if len(gap) else min(stop + CHUNK, len(raw))
        yield _WORD_BYTES[raw[at:stop]]
        at = stop


def dense_counts(data: np.ndarray, ends: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of every text, and its feature counts over all buckets as one row a text."""
    rows = len(ends)
    owner, crc, pairs = features(data, ends, buckets)
    has = pairs >= 0
    at = np.concatenate([owner * buckets + crc % np.uint32(buckets), owner[has] * buckets + pairs[has]])
    return np.bincount(owner, minlength=rows), np.bincount(at, minlength=rows * buckets).reshape(rows, buckets)


def long_counts(raw: np.ndarray, buckets: int) -> tuple[int, np.ndarray]:
    """As ``dense_counts`` for one text of any length, with memory for one piece of it."""
    words, counts, before = 0, np.zeros(buckets, np.int64), None
    for piece in _pieces(raw):
        _, crc, pairs = features(piece, np.array([len(piece)]), buckets)
        if not len(crc):
            continue
        words += len(crc)
        counts += np.bincount(crc % np.uint32(buckets), minlength=buckets) + np.bincount(pairs[pairs >= 0], minlength=buckets)
        if before is not None:  # the pair over the cut
            begin = int(np.argmax(piece > 0))
            gap = np.flatnonzero(piece[begin:] == 0)
            counts[_follower(before, piece[begin:begin + int(gap[0]) if len(gap) else len(piece)]) % buckets] += 1
        before = int(crc[-1])
    return words, counts


def _histogram(buckets: int):
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, ends in _slices(batch.column(0)):
                if len(data) > CHUNK:
                    total += long_counts(data, buckets)[1]
                    continue
                _, crc, pairs = features(data, ends, buckets)
                total += np.bincount(crc % np.uint32(buckets), minlength=buckets) + np.bincount(pairs[pairs >= 0], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])
    return run


def bucket_counts(df: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """``bucket, n`` over all texts; every task sends at most one row a bucket."""
    part = df.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(_histogram(buckets), "bucket long, n long")
    return part.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> np.ndarray:
    """``floor(1000 ln((t+1)(S+buckets) / ((s+1)(T+buckets))))`` of every bucket, whole products divided once."""
    s_all, t_all = sum(corpus.values()) + buckets, sum(target.values()) + buckets
    return np.array([math.floor(1000 * math.log((target.get(b, 0) + 1) * s_all / ((corpus.get(b, 0) + 1) * t_all)))
                     for b in range(buckets)], np.int64)


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    packed = np.packbits(bits, axis=1)
    wide = np.zeros((len(packed), -(-packed.shape[1] // 8) * 8), np.uint8)
    wide[:, :packed.shape[1]] = packed
    return wide.view(np.uint64)


def gain_planes(gain: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """``(signed power of two, plane)`` of the gains: magnitudes bit by bit, apart by sign."""
    out = []
    for sign in (1, -1):
        size = np.where(gain * sign > 0, np.abs(gain), 0)
        out += [(sign << j, _packed(((size >> j) & 1)[None, :].astype(np.uint8))[0]) for j in range(int(size.max(initial=0)).bit_length())]
    return out


def sliced_sums(counts: np.ndarray, planes: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Sum of count times gain of every row of ``counts``, from the planes of both."""
    out = np.zeros(len(counts), np.int64)
    highest = counts.max(axis=1, initial=0)
    for i in range(int(highest.max(initial=0)).bit_length()):
        rows = np.flatnonzero(highest >> i)  # rows with counts that reach this plane
        plane = _packed(((counts[rows] >> i) & 1).astype(np.uint8))
        total = np.zeros(len(rows), np.int64)
        for power, gain in planes:
            total += power * np.bitwise_count(plane & gain).sum(axis=1, dtype=np.int64)
        out[rows] += total << i
    return out


def _weigh(gain: np.ndarray):
    def run(batches):
        buckets, planes = len(gain), gain_planes(gain)
        for batch in batches:
            words, sums = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for at, rows, data, ends in _slices(batch.column(1)):
                if len(data) > CHUNK:
                    words[at], counts = long_counts(data, buckets)
                    sums[at] = sliced_sums(counts[None, :], planes)[0]
                    continue
                for a in range(0, rows, ROWS):
                    b = min(a + ROWS, rows)
                    begin = int(ends[a - 1]) if a else 0
                    n, counts = dense_counts(data[begin:int(ends[b - 1])], ends[a:b] - begin, buckets)
                    words[at + a:at + b] = n
                    sums[at + a:at + b] = sliced_sums(counts, planes)
            n_features = np.maximum(2 * words - 1, 0)
            weight = np.floor_divide(sums, np.maximum(n_features, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(n_features), pa.array(weight)],
                                             names=["doc_id", "n_words", "n_features", "weight"])
    return run


def _collected(counts: DataFrame) -> dict[int, int]:
    """A histogram of at most ``buckets`` rows."""
    return {r["bucket"]: r["n"] for r in counts.collect()}


def weights(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            target_text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of every row of ``docs`` (see ``resample`` for the cases)."""
    gain = gains(_collected(bucket_counts(docs, text_col, buckets)),
                 _collected(bucket_counts(target, target_text_col, buckets)), buckets)
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return base.mapInArrow(_weigh(gain), "doc_id long, n_words long, n_features long, weight long")


def chance(doc_id: Column, seed: int) -> Column:
    """``floor(-1000 ln(-ln u))`` with u in (0, 1) from the id's SHA-256: the same for an id, whatever the partitioning."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10)
    return F.floor(-1000 * F.log(-F.log((h.cast("double") + 0.5) / 4294967296.0)))


def draw(weighed: DataFrame, share: int = SHARE, seed: int = SEED, min_words: int = MIN_WORDS) -> DataFrame:
    """``score`` and ``rank`` of every row of ``weights``; rows that aren't drawn have no rank.

    Ranks need no sort of all rows: scores are whole numbers, so the rows above a score are counted
    from the histogram of the scores, and only rows of one score are put in order by id.  The
    hashed part of the score spreads distinct ids, so one score holds under 0.04 % of them.
    """
    slim = staged(weighed.withColumn("score", F.col("weight") + chance(F.col("doc_id"), seed)), "weights")
    spark = slim.sparkSession
    able = F.col("n_words") >= min_words
    histogram = slim.where(able).groupBy("score").count().collect()  # at most MAX_SCORES rows
    size = {r["score"]: r["count"] for r in histogram}
    quota = sum(size.values()) * share // 100
    above, lines = 0, []
    for score in sorted(size, reverse=True):
        if above >= quota:
            break
        lines.append((score, above))
        above += size[score]
    offsets = spark.createDataFrame(lines, "at_score long, above long")
    found = slim.join(F.broadcast(offsets), able & (F.col("score") == F.col("at_score")), "left")
    out = F.row_number().over(Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last()))
    columns = ["doc_id", "n_features", "weight", "score"]
    ranked = found.where("above IS NOT NULL").withColumn("rank", (F.col("above") + out).cast("long"))
    return (ranked.select(*columns, F.when(F.col("rank") <= quota, F.col("rank")).alias("rank"), "n_words")
            .unionByName(found.where("above IS NULL").select(*columns, F.lit(None).cast("long").alias("rank"), "n_words")))


def resample(docs: DataFrame, target: DataFrame, share: int = SHARE, seed: int = SEED, min_words: int = MIN_WORDS,
             buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_features, weight, score, rank, n_words`` of every document.

    ``share`` hundredths of the documents with at least ``min_words`` words are drawn without
    replacement by the highest scores, weight plus Gumbel noise, ties to the smaller id.

    Cases: a null or empty text, or one without a word, has no features, weight 0 and its hashed
    score; a null id is hashed as an empty one and comes last among ties; repeated rows count each
    time and stand side by side in rank; other columns are ignored, whatever their names; an empty
    target leaves all gains to the smoothing; an empty table gives an empty result.
    """
    return draw(weights(docs, target, id_col, text_col, buckets=buckets), share, seed, min_words)
