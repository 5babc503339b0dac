"""Packing documents into training sequences: exact complements first, then best fit.

Lengths run from 1 to the sequence length, so the whole corpus is described by one
counter for each length. The plan is made on those counters alone: at most a few
patterns for each length, whatever the number of documents. Pieces then find their
place by their rank among the pieces of their length.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.tokens import encoder
from shelfmark.scratch import cut

SEQUENCE = 1024
VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_points(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: the remainder first, then full pieces."""
    first = n % capacity
    starts = ([(0, first)] if first else []) + [(first + k * capacity, capacity) for k in range(n // capacity)]
    return starts


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = SEQUENCE, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """One row for each piece of each document: doc_id, piece, start, length, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                out += [(doc, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(cut_points(len(ids), capacity))]
            columns = list(zip(*out)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, PIECES)


def _complement(avail: np.ndarray, gap: int, most: int = 3) -> tuple[int, ...] | None:
    """One, two or three (up to ``most``) available lengths that sum to ``gap``, as even as there are: the shortest pieces are the easiest to place later."""
    if avail[gap] > 0:
        return (gap,)

    def pair(total: int, spent: int = 0) -> tuple[int, int] | None:
        high = np.arange((total + 1) // 2, total)  # a >= b >= 1, the most even first
        need = 1 + (high * 2 == total) + (high == spent)
        good = (avail[high] >= need) & (avail[total - high] >= 1 + (total - high == spent))
        at = int(np.argmax(good)) if len(good) else 0
        return (int(high[at]), int(total - high[at])) if len(good) and good[at] else None

    if most < 2:
        return None
    if (found := pair(gap)) or most < 3:
        return found
    third = -(-gap // 3)  # the longest of three is no shorter
    for a in third + np.flatnonzero(avail[third : gap - 1]):
        if found := pair(gap - int(a), int(a)):
            return (int(a), *found)
    return None


def plan(counts: np.ndarray, capacity: int = SEQUENCE) -> list[tuple[Counter, int]]:
    """Patterns (lengths in one sequence, number of such sequences) that use up ``counts``.

    counts[n] is the number of pieces of length n. Single complements come first: two
    pieces that fill a sequence are together in some best packing. Then every length,
    longest first, looks for a pair and at last for a triple that fills its gap exactly,
    as often as counts allow. A combination is consumed only if best fit then needs no
    more sequences for what remains than before: exact fills that spend short pieces which
    longer ones need are left out. What is left is placed by best fit, longest first.
    """
    avail = counts.astype(np.int64).copy()
    made: list[tuple[Counter, int]] = []

    def take(lengths: Counter, times: int) -> None:
        for n, k in lengths.items():
            avail[n] -= k * times

    if avail[capacity]:
        made.append((Counter({capacity: 1}), int(avail[capacity])))
        avail[capacity] = 0
    for length in range(capacity - 1, (capacity - 1) // 2, -1):
        lengths = Counter((length, capacity - length))
        if times := min(int(avail[n]) // k for n, k in lengths.items()):
            take(lengths, times)
            made.append((lengths, times))
    least = _sequences(avail, capacity)
    for most in (2, 3):
        for length in range(capacity - 1, 0, -1):
            while avail[length]:
                avail[length] -= 1  # its own place
                rest = _complement(avail, capacity - length, most)
                avail[length] += 1
                if rest is None:
                    break
                lengths = Counter((length, *rest))
                times = min(int(avail[n]) // k for n, k in lengths.items())
                while times:
                    take(lengths, times)
                    if (now := times + _sequences(avail, capacity)) <= least:
                        least = now - times
                        made.append((lengths, times))
                        break
                    take(lengths, -times)
                    times //= 4
                if not times:
                    break
    return made + _best_fit(avail, capacity)


def _sequences(avail: np.ndarray, capacity: int) -> int:
    """How many sequences ``_best_fit`` makes, by counts of gaps alone."""
    having = [0] * (capacity + 1)
    gaps: list[int] = []  # those that some sequence has, in order
    made = 0

    def add(gap: int, times: int) -> None:
        if gap:
            if not having[gap]:
                insort(gaps, gap)
            having[gap] += times

    for length in np.flatnonzero(avail)[::-1].tolist():
        left = int(avail[length])
        at = bisect_left(gaps, length)
        while left and at < len(gaps):
            gap = gaps[at]
            fit = gap // length
            full = min(left // fit, having[gap])
            left -= full * fit
            some = left if full < having[gap] else 0
            left -= some
            having[gap] -= full + (some > 0)
            if not having[gap]:
                gaps.pop(at)
            if full:
                add(gap - fit * length, full)
            if some:
                add(gap - some * length, 1)
            at = bisect_right(gaps, gap)
        fit = capacity // length
        made += -(-left // fit)
        if left >= fit:
            add(capacity - fit * length, left // fit)
        if left % fit:
            add(capacity - left % fit * length, 1)
    return made


def _best_fit(avail: np.ndarray, capacity: int) -> list[tuple[Counter, int]]:
    """Best fit, longest first, over groups of equally filled sequences."""
    by_gap: dict[int, list[tuple[Counter, int]]] = defaultdict(list)
    for length in range(capacity, 0, -1):
        left = int(avail[length])
        for gap in sorted(g for g in by_gap if g >= length):
            fit = gap // length
            groups, by_gap[gap] = by_gap[gap], []
            for lengths, times in groups:
                full, some = min(left // fit, times), 0
                if full:
                    by_gap[gap - fit * length].append((lengths + Counter({length: fit}), full))
                    left -= full * fit
                if full < times and left:
                    some, left = left, 0
                    by_gap[gap - some * length].append((lengths + Counter({length: some}), 1))
                if spare := times - full - (some > 0):
                    by_gap[gap].append((lengths, spare))
            if not left:
                break
        fit = capacity // length
        if left >= fit:
            by_gap[capacity - fit * length].append((Counter({length: fit}), left // fit))
        if left % fit:
            by_gap[capacity - left % fit * length].append((Counter({length: left % fit}), 1))
    return [group for gap in sorted(by_gap) for group in by_gap[gap]]


def slots(patterns: list[tuple[Counter, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, rank after the last, first sequence, offset, pieces a sequence) of each run of pieces."""
    used: Counter = Counter()
    out, sequence = [], 0
    for lengths, times in patterns:
        offset = 0
        for length in sorted(lengths, reverse=True):
            k = lengths[length]
            out.append((length, used[length], used[length] + k * times, sequence, offset, k))
            used[length] += k * times
            offset += k * length
        sequence += times
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = SEQUENCE, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """Pack all documents into as few sequences of at most ``capacity`` tokens as the method finds.

    Returns a row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id,
    offset. A document longer than ``capacity`` is cut: its first piece is the remainder
    and the others are full. A null or empty text is the end id alone. Documents with a
    null or repeated id are packed like any other. An empty table gives no rows. Other
    columns are not read.

    What reaches the driver is one counter for each length; what is broadcast is the list
    of runs, at most a few thousand for 1,024 tokens: its size depends on ``capacity`` alone.
    """
    spark = docs.sparkSession
    cuts = cut(pieces(docs, id_col, text_col, capacity, vocabulary, end_id), "pieces")
    histogram = cuts.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most `capacity` rows
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for row in histogram:
        counts[row["length"]] = row["n"]
    runs = spark.createDataFrame(slots(plan(counts, capacity)), "length long, rank_from long, rank_to long, first_sequence long, first_offset long, per_sequence long")
    # as many rank groups for a length as each has pieces: neither grows beyond the root of the count
    groups = spark.createDataFrame([(int(n), math.isqrt(int(counts[n]) - 1) + 1) for n in np.flatnonzero(counts)], "length long, groups long")

    spread = cuts.join(F.broadcast(groups), "length").withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("groups"))).drop("groups")
    before = Window.partitionBy("length").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    offsets = spread.groupBy("length", "group").agg(F.count("*").alias("n")).select("length", "group", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "group").orderBy("doc_id", "piece", "ids_crc32")
    ranked = spread.join(offsets, ["length", "group"]).withColumn("rank", F.col("base") + F.row_number().over(within) - 1)
    place = F.col("rank") - F.col("rank_from")
    return (
        ranked.join(F.broadcast(runs), "length")
        .where((F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")))
        .select(
            "doc_id",
            "piece",
            "start",
            "length",
            "ids_crc32",
            (F.col("first_sequence") + F.floor(place / F.col("per_sequence"))).cast("long").alias("sequence_id"),
            (F.col("first_offset") + place % F.col("per_sequence") * F.col("length")).cast("long").alias("offset"),
        )
    )
