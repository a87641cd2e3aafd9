"""Best-fit packing of token sequences with large-item matching.

Lengths are integers from 1 to the capacity, so the whole packing problem is a histogram of at most
*capacity* counts, whatever the corpus. It is solved on the driver over groups of equal bins: items
above a third of the capacity are matched, at most two to a bin, the largest first with the largest
partner that fits; smaller items then go, in descending order, to the tightest gap. The plan maps (length,
ordinal) to a bin and an offset by intervals. Pieces get their ordinals from counts by (task, length),
and look their places up in the plan.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from asofkit.llm.common import bounded_batches, releasing, saved
from asofkit.llm.tokens import encoder

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, task int, ordinal bigint"


class _Plan:
    """Groups of bins with equal gaps; slots (length, first ordinal, number, first bin, offset)."""

    def __init__(self, capacity: int):
        self.capacity, self.bins = capacity, 0
        self.gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.sizes: list[int] = []
        self.slots: list[tuple[int, int, int, int, int]] = []
        self.placed: dict[int, int] = defaultdict(int)

    def open(self, number: int) -> int:
        first, self.bins = self.bins, self.bins + number
        return first

    def put(self, length: int, number: int, first: int, offset: int) -> None:
        self.slots.append((length, self.placed[length], number, first, offset))
        self.placed[length] += number

    def leave(self, gap: int, first: int, number: int) -> None:
        if gap and number:
            if not self.gaps[gap]:
                insort(self.sizes, gap)
            self.gaps[gap].append((first, number))

    def take(self, length: int) -> tuple[int, int, int] | None:
        """Removes a group with the tightest gap of at least *length*."""
        at = bisect_left(self.sizes, length)
        if at == len(self.sizes):
            return None
        gap = self.sizes[at]
        group = self.gaps[gap].pop()
        if not self.gaps[gap]:
            self.sizes.pop(at)
        return gap, *group


def plan_bins(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Slots for items with these counts by length, and the number of bins."""
    plan, left = _Plan(capacity), {n: c for n, c in counts.items() if c}
    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        n = large[-1]
        at = bisect_left(large, min(capacity - n, n) + 1) - 1
        m = large[at] if at >= 0 else 0
        if m == n and left[n] < 2:
            m = large[at - 1] if at >= 1 else 0
        pairs = 0 if not m else left[n] // 2 if m == n else min(left[n], left[m])
        if pairs:
            first = plan.open(pairs)
            plan.put(n, pairs, first, 0)
            plan.put(m, pairs, first, n)
            plan.leave(capacity - n - m, first, pairs)
            left[n] -= pairs
            left[m] -= pairs
        else:
            first = plan.open(left[n])
            plan.put(n, left[n], first, 0)
            plan.leave(capacity - n, first, left[n])
            left[n] = 0
        large = [x for x in large if left[x]] if not left[n] or not left.get(m, 1) else large
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        todo = left[n]
        while todo:
            if (found := plan.take(n)) is None:
                each = capacity // n
                bins = max(1, todo // each)
                plan.leave(capacity, plan.open(bins), bins)
                continue
            gap, first, number = found
            used = min(todo, number)
            plan.put(n, used, first, capacity - gap)
            plan.leave(gap, first + used, number - used)
            plan.leave(gap - n, first, used)
            todo -= used
    return plan.slots, plan.bins


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece of each document: PIECES, with the task that cut it and its ordinal there among equal lengths."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, task, seen = encoder(tokenizer), TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            rows = []
            for doc, ids in zip(batch["k"], encode.documents(batch["t"].tolist())):
                n = len(ids) // 4
                at, number, end = 0, 0, n % capacity or capacity  # the first piece takes what full pieces leave
                while at < n:
                    size = end - at
                    rows.append((doc, number, at, size, zlib.crc32(ids[4 * at : 4 * end]), task, seen[size]))
                    seen[size] += 1
                    at, number, end = end, number + 1, end + capacity
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "task", "ordinal"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    bounded_batches(docs.sparkSession)
    return docs.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t")).mapInPandas(releasing(cut), PIECES)


def pack(docs: DataFrame, tokenizer: str, *, capacity: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Packs every document, with its end token, into sequences of at most *capacity* tokens.

    Returns one row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. A document
    longer than *capacity* is cut into full pieces, but for the first, which takes what is left.
    Pieces of a sequence follow each other without gaps from offset 0.

    A null or empty text is the end token alone. Rows that repeat a key are documents of their own; a
    null key stays null. Other columns aren't read. An empty table gives an empty table.
    """
    pieces = saved(token_pieces(docs, tokenizer, capacity, key, text), "pieces")
    by_task = pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    by_length = by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most *capacity* rows
    slots, _ = plan_bins({r["length"]: r["n"] for r in by_length}, capacity)
    slots.sort()
    table = np.array(slots, dtype=np.int64).reshape(-1, 5)
    shared = docs.sparkSession.sparkContext.broadcast((table[:, 0] << 40 | table[:, 1], table[:, 1], table[:, 3], table[:, 4]))
    # Rows by length are at most one for each task.
    before = by_task.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = pieces.join(before.select("task", "length", F.coalesce("before", F.lit(0)).alias("before")), ["task", "length"])

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, firsts, bins, offsets = shared.value
        for batch in batches:
            ordinal = batch["ordinal"].to_numpy(np.int64)
            at = np.searchsorted(keys, batch["length"].to_numpy(np.int64) << 40 | ordinal, side="right") - 1
            batch["sequence_id"] = bins[at] + ordinal - firsts[at]
            batch["offset"] = offsets[at]
            yield batch.drop(columns="ordinal")

    wide = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("ordinal") + F.col("before")).alias("ordinal"))
    return wide.mapInPandas(releasing(place), "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
