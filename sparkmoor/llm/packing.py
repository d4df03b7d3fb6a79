"""Packing of documents into token sequences: dominance reduction, then best fit.

The instance of the packing problem is the number of pieces of each length, at most as many
numbers as a sequence has tokens, whatever the size of the corpus.  On these numbers the
reduction of Martello and Toth fixes for good the small sets of lengths that dominate every other
set with their longest member; the rest goes by best fit, longest first.  Equal steps are taken
for all pieces of a length at once, so the plan is a short list of patterns.

Pieces find their place in the plan by their rank among the pieces of their length: each task
numbers its own pieces and counts them, and the counts of earlier tasks are added.  No text and
no token is shuffled.

Defined cases: null and empty texts are the end id alone; a document longer than a sequence is
cut into full pieces after a first one that may be shorter, others are never cut; rows that
repeat, or share an id, are documents of their own; null ids stay null; an empty table gives an
empty result.  Other columns are never looked at.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, join_checked, pieces, stage
from .tokens import encoder

CAPACITY = 2048
FIELDS = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"


class Pattern(NamedTuple):
    """``times`` sequences that hold pieces of these lengths."""

    lengths: tuple[int, ...]
    times: int


def cut(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of a document of n tokens."""
    first = n % capacity
    return [first] * (first > 0) + [capacity] * (n // capacity) if n > capacity else [n]


def reduce(counts: dict[int, int], capacity: int) -> tuple[list[Pattern], Counter]:
    """Fix dominating sets until none is left: the fixed patterns and what remains.

    With j the longest member, k the longest other piece that fits beside it:
    * nothing fits: {j} alone;
    * j + k fills the sequence: {j, k};
    * no two further pieces fit beside j: {j, k};
    * no three fit, and no two that fit are longer together than k: {j, k}.
    In each case the members of any other set with j can be exchanged for k without needing more room.
    """
    left, fixed = Counter({n: c for n, c in counts.items() if c > 0}), []
    again = True
    while again:
        again = False
        sizes = sorted(left)
        for j in reversed(sizes):
            while left[j] > 0:
                left[j] -= 1                       # one j is set apart; the others may join it
                have = [s for s in sizes if left[s] > 0]
                at = bisect_left(have, capacity - j + 1) - 1
                k = have[at] if at >= 0 else 0
                room = capacity - j
                small: list[int] = []
                for s in have:
                    small += [s] * min(left[s], 3 - len(small))
                    if len(small) == 3:
                        break
                two = sum(small[:2]) if len(small) >= 2 else capacity
                three = sum(small) if len(small) == 3 else capacity
                sure = not k or k == room or two > room or (three > room and _best_pair(have, left, room) <= k)
                left[j] += 1
                if not sure:
                    break
                times = left[j] if not k else left[j] // 2 if k == j else min(left[j], left[k])
                if k and k != room:                # the proof looked at the pieces there are now
                    times = min(times, max(1, left[k] - (k == j) - 3))
                fixed.append(Pattern((j, k) if k else (j,), times))
                left[j] -= times
                if k:
                    left[k] -= times
                again = True
        left = +left
    return fixed, left


def _best_pair(have: list[int], left: Counter, room: int) -> int:
    best, b = 0, len(have) - 1
    for a, x in enumerate(have):
        while b > a and x + have[b] > room:
            b -= 1
        if b > a:
            best = max(best, x + have[b])
        if left[x] > 1 and 2 * x <= room:
            best = max(best, 2 * x)
        if b <= a:
            break
    return best


def best_fit(counts: Counter, capacity: int) -> list[Pattern]:
    """Best fit, longest first; all sequences of equal content are treated as one."""
    at_room: dict[int, list[Pattern]] = defaultdict(list)   # sequences by the room they have left
    rooms: list[int] = []
    done: list[Pattern] = []

    def put(pattern: Pattern, room: int) -> None:
        if pattern.times <= 0:
            return
        if not room:
            done.append(pattern)
            return
        if not at_room[room]:
            insort(rooms, room)
        at_room[room].append(pattern)

    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n > 0:
            i = bisect_left(rooms, size)
            if i == len(rooms):
                fits = capacity // size
                put(Pattern((size,) * fits, n // fits), capacity - fits * size)
                put(Pattern((size,) * (n % fits), 1 if n % fits else 0), capacity - (n % fits) * size)
                break
            room = rooms[i]
            pattern = at_room[room].pop()
            if not at_room[room]:
                rooms.pop(i)
            fits = room // size
            full = min(pattern.times, n // fits)
            put(Pattern(pattern.lengths + (size,) * fits, full), room - fits * size)
            n -= full * fits
            over = pattern.times - full
            if over and n:                          # fewer than one more sequence can take
                put(Pattern(pattern.lengths + (size,) * n, 1), room - n * size)
                over, n = over - 1, 0
            put(Pattern(pattern.lengths, over), room)
    return done + [p for room in rooms for p in at_room[room]]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    fixed, left = reduce(counts, capacity)
    return fixed + best_fit(left, capacity)


def slots(patterns: list[Pattern]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: the ranks at which slots begin, their first sequence and their offset inside it."""
    rows, used, sequence = defaultdict(list), Counter(), 0
    for p in patterns:
        offset = 0
        for n in p.lengths:
            rows[n].append((used[n], sequence, offset))
            used[n] += p.times
            offset += n
        sequence += p.times
    return {n: tuple(np.array(c, np.int64) for c in zip(*r)) for n, r in rows.items()}


def tokenised(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, doc_id: str = "doc_id",
              text: str = "text", keep_ids: bool = False) -> DataFrame:
    """Pieces with their rank among those of their length in the same task (with ``ids`` if asked for)."""
    names = [f.split()[0] for f in FIELDS.split(", ")] + ["ids"] * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()    # what earlier tasks of this worker have left
        encode, part, ranks = encoder(tokenizer).encode, TaskContext.get().partitionId(), Counter()
        for whole in batches:
            for batch in pieces(whole, 2 << 20):
                ids, counts = encode(batch.column(1).to_pylist())
                rows, at = [], 0
                for doc, n in zip(batch.column(0).to_pylist(), counts.tolist()):
                    own = np.append(ids[at:at + n], end_id).astype("<u4")
                    at, start = at + n, 0
                    for k, size in enumerate(cut(n + 1, capacity)):
                        data = own[start:start + size].tobytes()
                        rows.append((doc, k, start, size, zlib.crc32(data), part, ranks[size], *[data] * keep_ids))
                        ranks[size] += 1
                        start += size
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
                columns = list(zip(*rows)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")) \
        .mapInArrow(run, FIELDS + ", ids binary" * keep_ids)


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0, capacity: int = CAPACITY,
         doc_id: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece, with ``ids`` (unsigned
    32-bit, little-endian) if asked for."""
    cut_up = stage(tokenised(docs, tokenizer, end_id, capacity, doc_id, text, keep_ids))
    counts = stage(cut_up.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")))
    totals = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}   # one row per length
    places = docs.sparkSession.sparkContext.broadcast(slots(plan(totals, capacity)))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = stage(counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")))
    ranked = join_checked(cut_up, before, ["part", "length"], "inner") \
        .withColumn("rank", F.col("rank") + F.col("before")).drop("before", "part")
    fields = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_length = places.value
        for batch in batches:
            size, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            order = np.argsort(size, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(size[order])) + 1):
                if len(rows):
                    begin, first, inside = by_length[int(size[rows[0]])]
                    at = np.searchsorted(begin, rank[rows], "right") - 1
                    sequence[rows], offset[rows] = first[at] + rank[rows] - begin[at], inside[at]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in fields], pa.array(sequence), pa.array(offset)],
                names=[*fields, "sequence_id", "offset"])

    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, "
                             + "ids binary, " * keep_ids + "sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids): the sequences themselves, from pieces with ``ids``; a group is one
    sequence and so never larger than its capacity."""
    parts = F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("h"))))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("p")) \
        .select("sequence_id", "length", F.unhex(F.array_join("p.h", "")).alias("ids"))
