"""Shortest-pack-first packing over the length histogram.

A document is its token ids and an end id. Documents above the capacity give full
pieces and a rest; full pieces are sequences by themselves. The rests are planned as a
histogram: lengths go longest first into the shortest pack so far, a whole run of equal
packs at a time, and a new pack is opened only where the shortest has no room. The
volume allows a known number of full packs. Once that many are open, a length without
room is cut: its head fills the shortest pack and what remains goes on as a shorter
length. So all packs end full, at most one cut each, and the tokens left over, less than
one pack, are laid into packs of powers of two, which need no padding.

Documents find their places by rank: a task numbers the documents of each length it
reads, a table of offsets turns these numbers into ranks, and the plan (whose size
follows the capacity, not the documents) says where each rank of a length goes.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mixloom.llm.common import bounded_batches, land, pack, unpack
from mixloom.llm.packing import _encoder

CAPACITY = 1024
END = 0  # the id appended to every document
#: Above so many rows the table of offsets is no longer broadcast by hint; Spark decides.
BROADCAST_ROWS = 1 << 20
_RANK_BITS = 42


@dataclass
class Plan:
    """Where the ranks of each length go; a row serves ``each`` ranks a sequence."""

    capacity: int
    pairs: np.ndarray  # (length, start) of the rows, as length * (capacity + 1) + start, sorted
    keys: np.ndarray  # number of the pair in the high bits, first rank below; sorted
    first: np.ndarray
    size: np.ndarray
    sequence: np.ndarray
    each: np.ndarray
    offset: np.ndarray

    def places(self, length: np.ndarray, start: np.ndarray, rank: np.ndarray):
        """Size, sequence and offset of the pieces that begin at ``start``."""
        pair = np.searchsorted(self.pairs, length * (self.capacity + 1) + start)
        row = np.searchsorted(self.keys, (pair << _RANK_BITS) | rank, "right") - 1
        inside = rank - self.first[row]
        size, each = self.size[row], self.each[row]
        return size, self.sequence[row] + inside // each, self.offset[row] + inside % each * size


def plan_packs(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[Plan, int]:
    """The plan for a histogram of lengths from 1 to ``capacity``, and its sequences.

    All sequences but the last are exactly full; the last ones, at most one for each
    bit of the capacity, hold less than a pack together and have powers of two as
    lengths. An empty histogram has an empty plan.
    """
    rows: list[tuple] = []  # length, first rank, start, size, first sequence, a sequence, offset
    full = histogram.get(capacity, 0)
    if full:
        rows.append((capacity, 0, 0, capacity, 0, 1, 0))
    volume = sum(n * c for n, c in histogram.items() if n < capacity)
    wanted, rest = divmod(volume, capacity)
    # what is still to be placed, by remaining length: (length, first rank, ranks, start)
    buckets: dict[int, list] = defaultdict(list)
    for n, c in histogram.items():
        if n < capacity and c:
            buckets[n].append((n, 0, c, 0))
    packs: dict[int, list] = defaultdict(list)  # runs (first sequence, how many) by used tokens
    heap: list[int] = []

    def keep(used: int, first: int, many: int) -> None:
        if used < capacity:
            if not packs[used]:
                heapq.heappush(heap, used)
            packs[used].append((first, many))

    opened, tail = 0, _Tail(rest, full + wanted)
    for size in range(capacity - 1, 0, -1):
        for length, rank, many, start in buckets.pop(size, ()):  # a cut adds to shorter lengths only
            while many:
                used = heap[0] if heap else None
                if used is None or used + size > capacity:
                    if opened < wanted:
                        # a new pack is the shortest one until it has no room: fill it, and its like
                        each = min(capacity // size, many)
                        new = min(many // each, wanted - opened)
                        rows.append((length, rank, start, size, full + opened, each, 0))
                        keep(each * size, full + opened, new)
                        opened, rank, many = opened + new, rank + new * each, many - new * each
                        continue
                    if used is None:  # all packs are full
                        rows += tail.take(length, rank, many, start, size)
                        break
                first, there = packs[used].pop()
                if not packs[used]:
                    heapq.heappop(heap)
                room = capacity - used
                if size > room:  # the head fills the pack, the remainder goes on
                    step = min(many, there)
                    rows.append((length, rank, start, room, first, 1, used))
                    buckets[size - room].append((length, rank, step, start + room))
                    taken = step
                else:
                    # several in a pack as long as it stays the shortest one
                    above = heap[0] if heap else capacity
                    each = min(room // size, max(0, above - used) // size + 1, max(1, many // there))
                    step = min(many // each, there)
                    rows.append((length, rank, start, size, first, each, used))
                    keep(used + each * size, first, step)
                    taken = step * each
                if step < there:
                    keep(used, first + step, there - step)
                rank, many = rank + taken, many - taken
    table = np.array(sorted(rows, key=lambda r: (r[0], r[2], r[1])), np.int64).reshape(-1, 7)
    joint = table[:, 0] * (capacity + 1) + table[:, 2]
    pairs = np.unique(joint)
    keys = (np.searchsorted(pairs, joint) << _RANK_BITS) | table[:, 1]
    plan = Plan(capacity, pairs, keys, table[:, 1], table[:, 3], table[:, 4], table[:, 5], table[:, 6])
    return plan, full + wanted + tail.sequences


class _Tail:
    """What is left when all packs are full, in sequences of powers of two."""

    def __init__(self, tokens: int, sequence: int):
        self.rooms = [1 << b for b in reversed(range(tokens.bit_length())) if tokens >> b & 1]
        self.sequences = len(self.rooms)
        self.sequence, self.used = sequence, 0

    def take(self, length: int, rank: int, many: int, start: int, size: int) -> Iterator[tuple]:
        for k in range(rank, rank + many):
            at, left = start, size
            while left:
                step = min(left, self.rooms[0] - self.used)
                yield length, k, at, step, self.sequence, 1, self.used
                at, left, self.used = at + step, left - step, self.used + step
                if self.used == self.rooms[0]:
                    self.rooms.pop(0)
                    self.sequence, self.used = self.sequence + 1, 0


def token_pieces(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    end: int = END,
    text: str = "text",
    doc_id: str = "doc_id",
) -> DataFrame:
    """Full pieces and the rest of every document, numbered by task and length.

    Columns doc_id, start, length, ids_crc32, doc_tokens, ids (packed, of rests only),
    part and nth: the piece is the nth of its length in task ``part``.
    """
    bounded_batches(docs.sparkSession)
    source = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    long = F.lit(0).cast("long")
    schema = source.select(
        "doc_id", *[long.alias(c) for c in ("start", "length", "ids_crc32", "doc_tokens")],
        F.lit(None).cast("binary").alias("ids"), F.lit(0).alias("part"), long.alias("nth"),
    ).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer)
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            row, start, length, crc, tokens, packed, nth = [], [], [], [], [], [], []
            for i, value in enumerate(batch.column(1)):
                ids = np.append(encode(value.as_py() or ""), end).astype("<u4")
                for a in range(0, len(ids), capacity):
                    own = ids[a : a + capacity]
                    row.append(i)
                    start.append(a)
                    length.append(len(own))
                    crc.append(crc32(own.tobytes()))
                    tokens.append(len(ids))
                    packed.append(pack(own) if len(own) < capacity else None)
                    nth.append(int(seen[len(own)]))
                    seen[len(own)] += 1
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(row, pa.int64())),
                    *[pa.array(x, pa.int64()) for x in (start, length, crc, tokens)],
                    pa.array(packed, pa.binary()),
                    pa.array([part] * len(row), pa.int32()),
                    pa.array(nth, pa.int64()),
                ],
                names=schema.names,
            )

    return source.mapInArrow(run, schema)


def pack_histogram(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    end: int = END,
    text: str = "text",
    doc_id: str = "doc_id",
) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece.

    A null text counts as empty, so every row gives at least its end id; repeated rows
    are placed one by one, a null id stays null. Very long texts give as many full
    pieces as they hold. Other columns play no part. An empty table gives no piece.

    Only the histogram (at most ``capacity`` rows) reaches the driver, and the plan
    made of it goes out. A length that a third of all documents share is no group
    anywhere: ranks come from numbers within tasks and one offset a task and length.
    """
    spark = docs.sparkSession
    landed = land(token_pieces(docs, tokenizer, capacity, end, text, doc_id), "token_pieces")
    counts = land(landed.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "length_counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan, _ = plan_packs(histogram, capacity)
    shared = spark.sparkContext.broadcast(plan)  # rows follow the capacity, not the documents

    # at most one row a task in a window
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("before")
    )
    if counts.count() <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    ranked = landed.join(offsets, ["part", "length"]).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", (F.col("before") + F.col("nth")).alias("rank")
    )
    schema = landed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    ).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        for batch in batches:
            start, length, crc, tokens = (
                batch.column(c).to_numpy(zero_copy_only=False) for c in ("start", "length", "ids_crc32", "doc_tokens")
            )
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            own, at = np.arange(len(length)), np.zeros(len(length), np.int64)
            while len(own):
                size, sequence, offset = plan.places(length[own], at, rank[own])
                sums = crc[own]
                for k in np.flatnonzero(size < length[own]):  # a piece of a document that was cut
                    ids = unpack(batch.column("ids")[own[k]].as_py(), "<u4")
                    sums[k] = crc32(ids[at[k] : at[k] + size[k]].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array(own)),
                        *map(pa.array, (start[own] + at, size, sums, tokens[own], sequence, offset)),
                    ],
                    names=schema.names,
                )
                at = at + size
                more = at < length[own]
                own, at = own[more], at[more]

    return ranked.mapInArrow(run, schema)
