"""Documents as chunks of word codes: a chunk's distinct words and where they stand.

A chunk is a bounded stretch of a partition's documents. Words leave a chunk once
each, dealt out by hash; what is found for them comes back by chunk and position.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext

CHUNK_BYTES = 24 << 20


@dataclass
class Chunk:
    ident: int
    keys: pa.Array  # what is carried of each document
    sizes: np.ndarray  # words of each document
    codes: np.ndarray  # word numbers, document after document
    words: pa.Array  # distinct words, ordered by part
    cuts: np.ndarray  # where the words of each part begin


def chunks(batches: Iterator[pa.RecordBatch], parts: int, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Chunks of a partition with columns (key, words array<string>)."""
    context = TaskContext.get()
    ident = (context.partitionId() if context else 0) << 24
    keys, lists, held = [], [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            words = part.column(1)
            keys.append(part.column(0))
            lists.append(words)
            flat = words.flatten()
            held += pc.sum(pc.binary_length(flat)).as_py() or 0
            held += 4 * len(flat) + 16 * len(words)
            if held >= limit:
                yield _chunk(ident, keys, lists, parts)
                ident += 1
                keys, lists, held = [], [], 0
    if keys:
        yield _chunk(ident, keys, lists, parts)


def _chunk(ident: int, keys: list, lists: list, parts: int) -> Chunk:
    sizes = np.concatenate(
        [pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False) for x in lists]
    ).astype(np.int64)
    coded = pa.chunked_array([x.flatten() for x in lists], pa.string()).dictionary_encode()
    coded = coded.combine_chunks()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.chunk(0)
    words = coded.dictionary
    part = _parts_of(words, parts)
    order = np.argsort(part, kind="stable")
    number = np.empty(len(words), np.uint32)
    number[order] = np.arange(len(words), dtype=np.uint32)
    codes = number[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.empty(0, np.uint32)
    return Chunk(
        ident,
        pa.concat_arrays(keys),
        sizes,
        codes,
        words.take(pa.array(order, pa.int64())),
        np.searchsorted(part[order], np.arange(parts + 1)),
    )


def _parts_of(words: pa.Array, parts: int) -> np.ndarray:
    """A part for each word, by a hash of its bytes and their places."""
    sizes = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    data = np.frombuffer(b"".join(words.cast(pa.binary()).to_pylist()), np.uint8)
    starts = np.cumsum(sizes) - sizes
    places = np.arange(sizes.max(initial=0), dtype=np.uint64)
    weights = _mixed(places + np.uint64(1))[np.arange(len(data)) - np.repeat(starts, sizes)]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data + np.uint64(1)) * weights, out=sums[1:])
    return (_mixed(sums[starts + sizes] - sums[starts]) % np.uint64(parts)).astype(np.int64)


def _mixed(x: np.ndarray) -> np.ndarray:
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(factor)
    return x ^ (x >> np.uint64(33))


def listed(values: pa.Array) -> pa.Array:
    """All values as the one list of a one-row column."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
