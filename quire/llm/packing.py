"""Best-fit packing of documents into sequences by exact-complement hashing.

Pieces are first planned as counts of lengths, never one by one: a histogram has at most
`capacity` entries, whatever the input. From the longest length down, the gap it leaves
is looked up in an index of single, pair and triple lengths by their sum, and a combination
that fills it exactly is used as often as the counts allow. What has no exact complement
is filled best-fit. The plan is a list of intervals of ranks, and a
piece finds its sequence from its length and its rank among pieces of that length.

Ranks come from a range sort by (length, id, piece), so a length that a third of all
pieces share is spread over many partitions.

Defined results: null text is empty and holds only the end id; rows that repeat an id, or
have none, are packed each for itself; texts of any length are cut into as many pieces as
they need; an empty table gives no rows. Extra columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens

CAPACITY = 1024
#: Pieces in one partition of the rank sort, and most partitions of it.
RANK_ROWS, RANK_PARTS = 200_000, 10_000


@dataclass(frozen=True)
class Slot:
    """Pieces of `length` with ranks from `rank` on: `times` places in each of `bins`
    sequences from `sequence` on, the first of them at `offset`."""

    length: int
    rank: int
    bins: int
    sequence: int
    offset: int
    times: int


class Complements:
    """Single lengths, pairs and triples by their sum, as long as counts last.

    A gap's combinations are queued when it is first asked for, and leave the queue when
    they have run out: counts only fall, and a gap always belongs to the same first length,
    so one that does not fit now will never fit again.
    """

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.n, self.capacity = np.zeros(capacity + 1, dtype=np.int64), capacity
        for length, count in histogram.items():
            self.n[length] = count
        self.by_sum: dict[int, list[Iterator[list[int]]]] = {}

    def fits(self, pattern: list[int]) -> int:
        """How often the pattern can be taken."""
        return min(int(self.n[x]) // pattern.count(x) for x in pattern)

    def _pairs(self, total: int) -> np.ndarray:
        """Available a >= b with this sum, the longest a first."""
        a = np.arange(total - 1, (total + 1) // 2 - 1, -1)
        a = a[(self.n[a] > 0) & (self.n[total - a] > 0)]
        return np.stack([a, total - a], axis=1)

    def _triples(self, total: int) -> Iterator[list[int]]:
        for a in range(total - 2, -(-total // 3) - 1, -1):
            if self.n[a] > 0:
                yield from ([a, *own] for own in self._pairs(total - a).tolist() if own[0] <= a)

    def filling(self, gap: int) -> list[int] | None:
        """A combination that fills the gap behind a piece of capacity - gap exactly."""
        first = self.capacity - gap
        if gap not in self.by_sum:
            self.by_sum[gap] = [iter([[gap]]), iter(self._pairs(gap).tolist()), self._triples(gap)]
        queues = self.by_sum[gap]
        while queues:
            for found in queues[0]:
                if self.fits([first, *found]):
                    queues[0] = itertools.chain([found], queues[0])  # it may fit again
                    return found
            queues.pop(0)
        return None


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Slot], int]:
    """Slots for all counted pieces, and the number of sequences."""
    counts = Complements(histogram, capacity)
    used, slots, sequence = dict.fromkeys(histogram, 0), [], 0

    def take(pattern: list[int]) -> None:
        nonlocal sequence
        bins, offset = counts.fits(pattern), 0
        for length in sorted(set(pattern), reverse=True):
            times = pattern.count(length)
            slots.append(Slot(length, used[length], bins, sequence, offset, times))
            used[length] += bins * times
            counts.n[length] -= bins * times
            offset += times * length
        sequence += bins

    for longest in range(capacity, 0, -1):
        while counts.n[longest]:
            gap = capacity - longest
            if not gap:
                take([longest])
                continue
            if found := counts.filling(gap):
                take([longest, *found])
                continue
            pattern = [longest]
            while gap:  # best fit: the longest that still goes in
                left = [int(x) for x in np.flatnonzero(counts.n[1 : gap + 1])[::-1] + 1]
                best = next((x for x in left if counts.fits([*pattern, x])), None)
                if best is None:
                    break
                times = min(gap // best, max(1, int(counts.n[best]) // max(1, int(counts.n[longest]))), int(counts.n[best]) - pattern.count(best))
                pattern += [best] * times
                gap -= best * times
            take(pattern)
    return slots, sequence


def pieces(docs: DataFrame, tokenizer: str, keeps_space: bool, end_id: int, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document cut into pieces."""

    def cut(batches):
        enc = tokens.encoder(tokenizer, keeps_space)
        for batch in batches:
            rows = []
            for k in range(0, len(batch), 200):
                some = batch.iloc[k : k + 200]
                for i, ids in zip(some["doc_id"], enc.encode([t or "" for t in some["text"]], end_id), strict=True):
                    start, piece = 0, 0
                    while start < len(ids):
                        end = start + ((len(ids) - start - 1) % capacity + 1 if not piece else capacity)
                        rows.append((i, piece, start, end - start, zlib.crc32(ids[start:end])))
                        start, piece = end, piece + 1
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return slim.mapInPandas(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces with a length of 1 to capacity."""
    columns = cut.columns
    rows = common.written(cut, "pieces")
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    slots, _ = plan(histogram, capacity)
    parts = min(RANK_PARTS, max(1, -(-sum(histogram.values()) // RANK_ROWS)))
    ranked = rows.repartitionByRange(parts, "length", "doc_id", "piece").sortWithinPartitions("length", "doc_id", "piece")
    ranked = common.written(ranked.withColumn("_place", F.monotonically_increasing_id()), "ranked-pieces")
    part = F.shiftright("_place", 33)
    sizes = {r["p"]: r["n"] for r in ranked.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}  # at most RANK_PARTS rows
    bases, total = {}, 0
    for p in sorted(sizes):
        bases[p], total = total, total + sizes[p]
    below, total = {}, 0
    for length in sorted(histogram):
        below[length], total = total, total + histogram[length]
    slots = sorted(slots, key=lambda s: (s.length, s.rank))
    keys = np.array([below[s.length] + s.rank for s in slots], dtype=np.int64)
    table = np.array([(s.bins, s.sequence, s.offset, s.length) for s in slots], dtype=np.int64).reshape(-1, 4)

    def place(batches):
        for batch in batches:
            at = batch["_place"].to_numpy()
            p = at >> 33
            rank = at - (p << 33) + np.array([bases[x] for x in p], dtype=np.int64)
            k = np.searchsorted(keys, rank, side="right") - 1
            bins, sequence, offset, length = table[k].T
            nth = rank - keys[k]
            yield batch[columns].assign(sequence_id=sequence + nth % np.maximum(bins, 1), offset=offset + nth // np.maximum(bins, 1) * length)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema)
    return ranked.mapInPandas(place, f"{kinds}, sequence_id long, offset long")
