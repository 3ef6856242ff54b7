"""Best-fit packing by large-item matching.

Documents become token pieces of at most `capacity`. What has to be decided is small: how many pieces there are of each
length (at most `capacity` numbers). On these counts a plan is made: pieces above a third of the capacity go at most two
to a bin, the longest with the longest that still fits; shorter ones, longest first, go into the tightest gap that
takes them, or open new bins. The plan says, for each length, which ranks of that length go where; each piece's
rank is its place in its task (counted as the pieces are made) after the counts of the tasks before it. No piece is
sorted, and equal lengths, however many, never meet in one task.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebar.llm.common import slices, staged
from tidebar.llm.tokens import encoder

CAPACITY = 1024
END = 2


def plan_bins(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """(rows of (length, first rank, first bin, bins, offset), bins used) for so many pieces of each length."""
    left = {length: n for length, n in counts.items() if n}
    rank = dict.fromkeys(left, 0)
    rows, bins = [], 0
    gaps: dict[int, list[tuple[int, int]]] = {}  # free tokens -> (first bin, bins)
    order: list[int] = []

    def put(length: int, first: int, n: int, offset: int) -> None:
        rows.append((length, rank[length], first, n, offset))
        rank[length] += n
        left[length] -= n

    def leave(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                gaps[gap] = []
                insort(order, gap)
            gaps[gap].append((first, n))

    large = sorted((x for x in left if 3 * x > capacity), reverse=True)
    for length in large:
        while left[length]:
            mate = next((x for x in large if x <= length and x + length <= capacity and left[x] - (x == length) > 0), 0)
            n = left[length] if not mate else left[length] // 2 if mate == length else min(left[length], left[mate])
            put(length, bins, n, 0)
            if mate:
                put(mate, bins, n, length)
            leave(capacity - length - mate, bins, n)
            bins += n
    for length in sorted((x for x in left if 3 * x <= capacity), reverse=True):
        while left[length]:
            at = bisect_left(order, length)
            if at < len(order):
                gap = order[at]
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], order[at]
            else:
                gap, first = capacity, bins
                n = -(-left[length] // (capacity // length))
                bins += n
            each = gap // length
            full = min(n, left[length] // each)
            for i in range(each if full else 0):
                put(length, first, full, capacity - gap + i * length)
            leave(gap - each * length, first, full)
            first, n = first + full, n - full
            if n and left[length]:
                some = left[length]  # fewer than a bin takes
                for i in range(some):
                    put(length, first, 1, capacity - gap + i * length)
                leave(gap - some * length, first, 1)
                first, n = first + 1, n - 1
            leave(gap, first, n)
    return np.array(rows, np.int64).reshape(-1, 5), bins


_PIECE = "piece int, start long, length long, ids_crc32 long, __task int, __rank long"


def _cut(capacity: int, end: int, vocabulary: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(vocabulary)
        task = TaskContext.get().partitionId()
        met = np.zeros(capacity + 1, np.int64)
        for part in slices(batches):
            ids, cuts = known.encode(part.column("text"))
            rows = part.num_rows
            tokens = np.insert(ids, cuts[1:], end).astype("<u4")
            total = np.diff(cuts) + 1
            base = np.cumsum(total) - total
            head = (total - 1) % capacity + 1  # the first piece takes what the others leave
            pieces = (total - head) // capacity + 1
            row = np.repeat(np.arange(rows), pieces)
            number = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = np.where(number == 0, 0, head[row] + (number - 1) * capacity)
            length = np.where(number == 0, head[row], capacity)
            view = memoryview(tokens).cast("B")
            crc = [zlib.crc32(view[4 * a : 4 * (a + n)]) for a, n in zip((base[row] + start).tolist(), length.tolist(), strict=True)]
            by = np.argsort(length, kind="stable")
            seen = np.bincount(length, minlength=capacity + 1)
            rank = np.empty(len(row), np.int64)
            rank[by] = np.arange(len(row)) - np.repeat(np.cumsum(seen) - seen, seen)
            rank += met[length]
            met += seen
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("__id").take(pa.array(row)),
                    pa.array(number, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                    pa.array(np.full(len(row), task), pa.int32()),
                    pa.array(rank, pa.int64()),
                ],
                ["__id", "piece", "start", "length", "ids_crc32", "__task", "__rank"],
            )

    return run


def _place(plan: np.ndarray):
    order = np.lexsort((plan[:, 1], plan[:, 0]))
    length, rank, first, _, offset = plan[order].T
    # ranks of a length follow one another, so one search finds the row
    span = np.int64(max(1, int((plan[:, 1] + plan[:, 3]).max(initial=0)) + 1))
    keys = length * span + rank

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            own, r = (part.column(c).to_numpy(zero_copy_only=False) for c in ("length", "__rank"))
            at = np.searchsorted(keys, own * span + r, "right") - 1
            names = ["__id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in names), pa.array(first[at] + r - rank[at], pa.int64()), pa.array(offset[at], pa.int64())], [*names, "sequence_id", "offset"]
            )

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END, vocabulary: str | None = None) -> DataFrame:
    """Packs all documents into sequences of at most `capacity` tokens; one row per piece.

    A document is its token ids and then `end`; longer ones are cut into pieces of `capacity`, of which the first may be
    shorter. Returns id_col, piece (from 0), start (the document's ids before it), length, ids_crc32, sequence_id, offset
    (place in the sequence, gapless from 0). A null or empty text is its end token alone. Repeated rows are packed as
    often as they come; ids may be null. Other columns of docs are not read. No rows in, no rows out.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    made = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).mapInArrow(_cut(capacity, end, vocabulary), f"__id {kind}, {_PIECE}")
    made = staged(made, "pieces")  # ranks are counted per task, so all that follows reads the same tasks' rows
    counts = made.groupBy("length", "__task").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("__task").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select(F.col("length").alias("__length"), F.col("__task").alias("__of"), F.coalesce(before, F.lit(0)).alias("__base"))
    totals = {x["length"]: x["n"] for x in made.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    plan, _ = plan_bins(totals, capacity)
    ranked = made.join(bases, (F.col("length") == F.col("__length")) & (F.col("__task") == F.col("__of"))).withColumn("__rank", F.col("__rank") + F.col("__base"))
    ranked = ranked.select("__id", "piece", "start", "length", "ids_crc32", "__rank")
    out = ranked.mapInArrow(_place(plan), f"__id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.withColumnRenamed("__id", id_col)
