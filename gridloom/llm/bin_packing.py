"""Best-fit decreasing packing of tokenised documents into sequences of a fixed length.

Pieces of one length are interchangeable to best-fit decreasing, so the packing depends on the
histogram of lengths alone, which has as many entries as a sequence has tokens, however large the
corpus. The driver runs best-fit decreasing over it, a length at a time: a segment tree over the
remaining capacities finds the tightest open bin in logarithmic time, and bins with one capacity
are kept as ranges of numbers, filled many at a time. The outcome is a list of runs: "of the pieces
of length l, those ranked a to b go to bins from c on, k to a bin, from offset o". It is the very
packing that the sequential algorithm makes.

Each piece then needs its rank among the pieces of its length: a rank within its partition of a
written table plus the number of such pieces in partitions before it.

Defined results: a null or empty text is one piece, its end token; repeated rows and repeated ids
are packed each for itself; an empty table gives an empty frame.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.common import materialise, slices, table
from gridloom.llm.tokens import encoder

CAPACITY = 2048
END_ID = 0

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, nth bigint"


@dataclass(frozen=True)
class Run:
    """Pieces of a length, by rank from `first`, `count` of them, into bins from `bin` on,
    `each` to a bin, in it from `offset` on."""

    length: int
    first: int
    count: int
    bin: int
    each: int
    offset: int


class Capacities:
    """Segment tree over the capacities 0 to `most`: which of them have open bins."""

    def __init__(self, most: int):
        self.size = 1 << (most + 1).bit_length()
        self.any = bytearray(2 * self.size)
        self.bins: list[list[tuple[int, int]]] = [[] for _ in range(most + 1)]

    def add(self, capacity: int, start: int, count: int) -> None:
        self.bins[capacity].append((start, count))
        at = capacity + self.size
        while at and not self.any[at]:
            self.any[at] = 1
            at //= 2

    def pop(self, capacity: int) -> tuple[int, int]:
        found = self.bins[capacity].pop()
        at = capacity + self.size
        if not self.bins[capacity]:
            self.any[at] = 0
            at //= 2
            while at:
                self.any[at] = self.any[2 * at] | self.any[2 * at + 1]
                at //= 2
        return found

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of an open bin that is at least `least`."""
        at = least + self.size
        if self.any[at]:
            return least
        while at > 1:
            if at % 2 == 0 and self.any[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.any[2 * at] else 2 * at + 1
                return at - self.size
            at //= 2
        return None


def best_fit_decreasing(lengths: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Run], int]:
    """Runs and number of bins for a histogram length -> count of pieces, lengths 1 to capacity."""
    open_bins, runs, bins = Capacities(capacity), [], 0
    for length in sorted(lengths, reverse=True):
        left, rank = lengths[length], 0
        while left:
            room = open_bins.tightest(length)
            if room is None:  # all that is left opens bins of its own
                room, start, have = capacity, bins, -(-left // (capacity // length))
                bins += have
            else:
                start, have = open_bins.pop(room)
            each = room // length
            full = min(have, left // each)
            if full:
                runs.append(Run(length, rank, full * each, start, each, capacity - room))
                if room - each * length:
                    open_bins.add(room - each * length, start, full)
                rank, left = rank + full * each, left - full * each
            start, have = start + full, have - full
            if have and left:  # fewer than a bin takes
                runs.append(Run(length, rank, left, start, each, capacity - room))
                open_bins.add(room - left * length, start, 1)
                start, have, left = start + 1, have - 1, 0
            if have:
                open_bins.add(room, start, have)
    return runs, bins


def _cut(batches: Iterator[pa.RecordBatch], capacity: int, end_id: int, tokenizer: tuple[str | None, str | None]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    encode, end, nth = encoder(*tokenizer).ids, end_id.to_bytes(4, "little"), [0] * (capacity + 1)
    for batch in slices(batches):
        out: list[list[int]] = [[] for _ in range(6)]
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids = encode(text or "") + end
            n = len(ids) // 4
            start, piece = 0, 0
            while start < n:
                # Only the first piece of a long document may be short.
                length = (n - start) % capacity or capacity
                row = (doc_id, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), nth[length])
                for column, value in zip(out, row):
                    column.append(value)
                nth[length] += 1
                start, piece = start + length, piece + 1
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        columns = [pa.array(c, k) for c, k in zip(out, kinds)]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array(np.full(len(out[0]), part, np.int32)), pa.array(out[5], pa.int64())],
            names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"],
        )


def _place(batches: Iterator[pa.RecordBatch], runs: dict[int, tuple[list[int], list[Run]]]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lengths, ranks = batch.column("length").to_pylist(), batch.column("rank").to_pylist()
        sequence, offset = [], []
        for length, rank in zip(lengths, ranks):
            firsts, own = runs[length]
            run = own[bisect_right(firsts, rank) - 1]
            row, slot = divmod(rank - run.first, run.each)
            sequence.append(run.bin + row)
            offset.append(run.offset + slot * length)
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())],
            names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
        )


def pack(
    docs: DataFrame,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    tokenizer: tuple[str | None, str | None] = (None, None),
) -> DataFrame:
    """Packs docs (doc_id, text): one row per piece with its sequence and its offset there.

    tokenizer: path of a tokenizer's JSON file, and of the rank file of the same vocabulary or None;
    both None for the public one."""
    cut = docs.select("doc_id", "text").mapInArrow(lambda batches: _cut(batches, capacity, end_id, tokenizer), PIECES)
    pieces = materialise(cut, "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    # At most `capacity` rows reach the driver.
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs, _ = best_fit_decreasing(histogram, capacity)
    by_length: dict[int, tuple[list[int], list[Run]]] = {}
    for run in runs:
        firsts, own = by_length.setdefault(run.length, ([], []))
        firsts.append(run.first)
        own.append(run)
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(F.col("part").alias("_part"), F.col("length").alias("_length"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, (F.col("part") == F.col("_part")) & (F.col("length") == F.col("_length"))).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("nth") + F.col("base")).alias("rank")
    )
    return ranked.mapInArrow(lambda batches: _place(batches, by_length), "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")


def op9_bin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `documents` packed into sequences of 2048 tokens."""
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op9_bin_packing": op9_bin_packing}
ORACLES: dict[str, str] = {}
