"""Best-fit packing by the linear grouping scheme, over a histogram of lengths.

Lengths are whole numbers up to the capacity, so the packing problem is a table
of (length, how many) of bounded size however many documents there are. Large
lengths are grouped into groups of equal cardinality and rounded up to the largest
of their group; the few sizes are packed by configurations; documents of the real
lengths take the places; small ones go where they fit best. The plan is kept as
runs of equal sequences, and documents find their place by their rank among those
of their length.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixloom.llm.common import bounded_batches, land

CAPACITY = 1024
GROUPS = 128
SMALL = 1 / 8
END = 2  # the id appended to every document


def pieces(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document.

    A document is its token ids and the end id; a null text is empty, so every row
    gives at least one piece. Only documents above the capacity are cut; their
    first piece takes what is left over when the rest is cut into full pieces.
    """
    bounded_batches(docs.sparkSession)
    schema = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), F.lit(0).alias("piece"),
        *[F.lit(0).cast("long").alias(c) for c in ("start", "length", "ids_crc32")],
    ).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer)
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, value in enumerate(batch.column(1)):
                ids = np.append(encode(value.as_py() or ""), END).astype("<u4")
                first = len(ids) % capacity or min(len(ids), capacity)
                cuts = [0, *range(first, len(ids), capacity), len(ids)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    row.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(crc32(ids[a:b].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(row, pa.int64())),
                    pa.array(piece, pa.int32()),
                    *[pa.array(x, pa.int64()) for x in (start, length, crc)],
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(
        run, schema
    )


@lru_cache(maxsize=2)
def _encoder(path: str):
    """Ids of a text as the tokenizer file gives them, special strings included."""
    import base64
    import json
    import os

    import public_tokenizers
    import tiktoken

    ranks_path = os.path.splitext(path)[0] + ".tiktoken"
    with open(path, encoding="utf-8") as f:
        special = {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    # the same vocabulary and merges, several times as fast as the other library
    coder = tiktoken.Encoding(
        "packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special
    )
    marks = list(special)

    def encode(text: str):
        if any(m in text for m in marks):
            return coder.encode(text, allowed_special="all")
        return coder.encode_to_numpy(text, disallowed_special=())

    return encode


def plan_packing(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[tuple]:
    """Runs (contents, how many) of sequences; contents are real lengths in order.

    Every length of the histogram is used exactly as often as it occurs and no
    sequence exceeds the capacity.
    """
    full = histogram.get(capacity, 0)
    large = sorted(
        ((n, c) for n, c in histogram.items() if SMALL * capacity < n < capacity), reverse=True
    )
    small = sorted(((n, c) for n, c in histogram.items() if n <= SMALL * capacity), reverse=True)
    grouped = linear_groups(large, groups)
    configurations = solve_configurations([(s, sum(c for _, c in own)) for s, own in grouped], capacity)
    runs = substitute(configurations, [list(own) for _, own in grouped])
    return [((capacity,), full)] * (full > 0) + best_fit(runs, small, capacity)


def linear_groups(large: list[tuple[int, int]], groups: int) -> list[tuple[int, list]]:
    """(rounded size, [(length, count)]) of groups with as many documents each."""
    total = sum(c for _, c in large)
    share = max(1, -(-total // groups))
    out: list[tuple[int, list]] = []
    room = 0
    for length, count in large:
        while count:
            if not room:
                out.append((length, []))
                room = share
            take = min(room, count)
            out[-1][1].append((length, take))
            room -= take
            count -= take
    merged: dict[int, list] = defaultdict(list)
    for size, own in out:
        merged[size].extend(own)
    return sorted(merged.items(), reverse=True)


def solve_configurations(sizes: list[tuple[int, int]], capacity: int) -> list[tuple[tuple, int]]:
    """(how many of each size, how often): fill one sequence after another as full as
    the sizes left allow (a bounded knapsack), and use each filling as often as it can be."""
    left = [c for _, c in sizes]
    out: list[tuple[tuple, int]] = []
    while any(left):
        first = next(i for i, c in enumerate(left) if c)
        filling = _fullest(sizes, left, first, capacity)
        often = min(left[i] // k for i, k in filling.items())
        for i, k in filling.items():
            left[i] -= k * often
        out.append((tuple(sorted(filling.items())), often))
    return out


def _fullest(sizes, left, first, capacity) -> dict[int, int]:
    """The fullest filling that holds the largest size left, by sums that can be reached."""
    room = capacity - sizes[first][0]
    reached: dict[int, tuple | None] = {0: None}
    for i in range(first, len(sizes)):
        size = sizes[i][0]
        limit = left[i] - (i == first)
        if limit <= 0 or size > room:
            continue
        for total in list(reached):
            for k in range(1, min(limit, (room - total) // size) + 1):
                if total + k * size not in reached:
                    reached[total + k * size] = (total, i, k)
        if room in reached:
            break
    filling: dict[int, int] = defaultdict(int)
    filling[first] += 1
    at = max(reached)
    while reached[at] is not None:
        at, i, k = reached[at]
        filling[i] += k
    return dict(filling)


def substitute(configurations, members: list[list]) -> list[tuple]:
    """Runs with real lengths in the places of the rounded sizes."""
    heads = [[list(x) for x in own] for own in members]
    runs: list[tuple] = []
    for filling, often in configurations:
        while often:
            step = min([often, *(heads[i][0][1] // k for i, k in filling)])
            contents = []
            if step:  # as many equal sequences as the heads of the groups allow
                for i, k in filling:
                    contents += [heads[i][0][0]] * k
                    heads[i][0][1] -= k * step
            else:  # one sequence across the seam of two lengths
                step = 1
                for i, k in filling:
                    for _ in range(k):
                        contents.append(heads[i][0][0])
                        heads[i][0][1] -= 1
                        if not heads[i][0][1]:
                            heads[i].pop(0)
            for i, _ in filling:
                if heads[i] and not heads[i][0][1]:
                    heads[i].pop(0)
            runs.append((tuple(contents), step))
            often -= step
    return runs


def best_fit(runs: list[tuple], small: list[tuple[int, int]], capacity: int) -> list[tuple]:
    """Small lengths, longest first, each into the fullest sequences that take it."""
    by_room: dict[int, list] = defaultdict(list)
    for contents, often in runs:
        by_room[capacity - sum(contents)].append((contents, often))
    for length, count in small:
        while count:
            room = next((r for r in range(length, capacity + 1) if by_room.get(r)), None)
            if room is None:
                by_room[capacity].append(((), -(-count // (capacity // length))))
                room = capacity
            contents, often = by_room[room].pop()
            k = room // length
            if count >= k * often:
                used, each = often, k
            elif count >= often:
                used, each = often, count // often
            else:
                used, each = count, 1
            if used < often:
                by_room[room].append((contents, often - used))
            by_room[room - each * length].append((contents + (length,) * each, used))
            count -= used * each
    return [run for room in sorted(by_room) for run in by_room[room] if run[1] and run[0]]


def placements(runs: list[tuple]) -> dict[int, np.ndarray]:
    """length -> rows (first rank, first sequence, places in the run, their index, offset)."""
    used: dict[int, int] = defaultdict(int)
    out: dict[int, list] = defaultdict(list)
    sequence = 0
    for contents, often in runs:
        at = 0
        for length in dict.fromkeys(contents):
            spots = contents.count(length)
            out[length].append((used[length], sequence, spots, at))
            used[length] += spots * often
            at += spots * length
        sequence += often
    return {length: np.array(rows, np.int64) for length, rows in out.items()}


def place(ranks: np.ndarray, length: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of the documents of one length with the given ranks."""
    row = table[np.searchsorted(table[:, 0], ranks, "right") - 1]
    inside = ranks - row[:, 0]
    return row[:, 1] + inside // row[:, 2], row[:, 3] + (inside % row[:, 2]) * length


def pack_sequences(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """Every piece of every document with its sequence_id and offset.

    Only the histogram of lengths (at most ``capacity`` numbers) and the plan
    reach the driver. Ranks within a length come from range partitions with
    stored numbers, so a length that a third of all pieces share is spread out.
    Equal rows are interchangeable. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    landed = land(pieces(docs, tokenizer, capacity, text, doc_id), "pieces")
    ranged = land(
        landed.repartitionByRange("length", "ids_crc32", "doc_id", "piece")
        .sortWithinPartitions("length", "ids_crc32", "doc_id", "piece")
        .withColumn("_row", F.monotonically_increasing_id()),
        "ranked",
    )
    part = F.shiftright("_row", 33)
    runs = (
        ranged.groupBy("length", part.alias("part"))
        .agg(F.min("_row").alias("first"), F.count(F.lit(1)).alias("n"))
        .collect()  # one row per partition and length at a boundary
    )
    histogram: dict[int, int] = defaultdict(int)
    shifts: dict[tuple[int, int], int] = {}
    for row in sorted(runs, key=lambda r: (r.length, r.part)):
        shifts[row.part, row.length] = histogram[row.length] - row.first
        histogram[row.length] += row.n
    tables = placements(plan_packing(dict(histogram), capacity))
    plan = spark.sparkContext.broadcast((shifts, tables))  # bounded by lengths and partitions

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift_of, table_of = plan.value
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            row = batch.column("_row").to_numpy(zero_copy_only=False)
            sequence, offset = np.empty_like(length), np.empty_like(length)
            both = (row >> 33) * (capacity + 1) + length
            for value in np.unique(both):
                own = np.flatnonzero(both == value)
                n, p = int(value % (capacity + 1)), int(value // (capacity + 1))
                sequence[own], offset[own] = place(row[own] + shift_of[p, n], n, table_of[n])
            kept = batch.drop_columns(["_row"])
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(sequence), pa.array(offset)],
                names=[*kept.schema.names, "sequence_id", "offset"],
            )

    schema = landed.select(
        "*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    ).schema
    return ranged.mapInArrow(run, schema)
