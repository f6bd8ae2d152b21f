"""SimHash near-duplicates with a pigeonring filter.

A fingerprint is cut into four segments seen as a ring. If two fingerprints differ
in at most 3 bits, then from some segment on, the differences of the next 1, 2, 3
and 4 segments are at most 0, 1, 2 and 3 in total. The first segment is the
shuffle key, the second is probed with one bit turned, the third is checked before
the full distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixloom.llm.common import bounded_batches, join_labels, land, with_text
from mixloom.llm.components import connected_components

SEGMENTS = 4
WIDTH = 64 // SEGMENTS
MAX_BITS = 3
_SLICE = 1 << 16
_PAIRS = 1 << 20


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the lower-cased (A-Z) word shingles, unsigned.

    Fewer words than a shingle holds give one shingle of them all; no words give 0.
    """
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = [e - 1 for e in accumulate(len(p) + 1 for p in parts)]
    starts = [0, *(e + 1 for e in ends[:-1])]
    k = min(words, len(parts))
    spans = list(zip(starts, ends[k - 1 :]))
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, len(spans), _SLICE):
        part = spans[at : at + _SLICE]
        hashes = np.fromiter((digest(joined[a:b], seed) for a, b in part), "<u8", len(part))
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    packed = np.packbits(2 * ones > len(spans), bitorder="little")
    return int(packed.view("<u8")[0])


def with_fingerprints(
    docs: DataFrame, carry: list[str], text: str = "text", out: str = "_fp"
) -> DataFrame:
    """The carried columns and the fingerprint as a signed long; a null text counts as empty."""
    columns = [F.col(f"`{c}`") for c in carry]
    source, at = with_text(docs, carry, text)
    schema = docs.select(*columns, F.lit(0).cast("long").alias(out)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at)
            found = np.fromiter(
                (fingerprint(t.as_py()) for t in texts), np.uint64, batch.num_rows
            )
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(carry)], pa.array(found.view(np.int64))], names=[*carry, out]
            )

    return source.mapInArrow(run, schema)


def chain_pairs(fps: np.ndarray, keys: np.ndarray, max_bits: int) -> Iterator[tuple]:
    """Index pairs of rows with equal keys that pass the ring's chain and the distance.

    ``keys`` holds the ring position in the bits above a segment's width and the
    segment's value below; rows are sorted by key and next segment.
    """
    turn = (keys >> WIDTH).astype(np.uint64)
    mask = np.uint64((1 << WIDTH) - 1)

    def segment(step):
        return (fps >> (((turn + np.uint64(step)) % np.uint64(SEGMENTS)) * np.uint64(WIDTH))) & mask

    second, third = segment(1), segment(2)
    joint = (keys.astype(np.uint64) << np.uint64(WIDTH)) | second
    limit = [max_bits * (k + 1) // SEGMENTS for k in range(SEGMENTS)]
    turned = [0] + [1 << b for b in range(WIDTH)] * (limit[1] > 0)
    for flip in turned:
        wanted = joint ^ np.uint64(flip)
        low = np.searchsorted(joint, wanted, "left")
        high = np.searchsorted(joint, wanted, "right")
        # each pair once: from the earlier row to the later one
        low = np.maximum(low, np.arange(len(joint)) + 1)
        counts = np.maximum(high - low, 0)
        reach = np.cumsum(counts)
        at = 0
        while at < len(counts):
            upto = int(np.searchsorted(reach, (reach[at - 1] if at else 0) + _PAIRS, "right"))
            upto = max(upto, at + 1)
            n = counts[at:upto]
            total = int(n.sum())
            if total:
                left = np.repeat(np.arange(at, upto), n)
                offset = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
                right = np.repeat(low[at:upto], n) + offset
                near = np.bitwise_count(second[left] ^ second[right]) + np.bitwise_count(
                    third[left] ^ third[right]
                )
                keep = near <= limit[2]
                left, right = left[keep], right[keep]
                keep = np.bitwise_count(fps[left] ^ fps[right]) <= max_bits
                yield left[keep], right[keep]
            at = upto


def _run_links(batches: Iterator[pa.RecordBatch], max_bits: int) -> Iterator[pa.RecordBatch]:
    held_k, held_f = np.empty(0, np.int64), np.empty(0, np.uint64)

    def links(keys, fps):
        turn = (keys >> WIDTH).astype(np.uint64)
        following = (fps >> (((turn + np.uint64(1)) % np.uint64(SEGMENTS)) * np.uint64(WIDTH))) & np.uint64(
            (1 << WIDTH) - 1
        )
        order = np.lexsort((following, keys))
        keys, fps = keys[order], fps[order]
        labels = np.arange(len(keys))
        for left, right in chain_pairs(fps, keys, max_bits):
            join_labels(labels, left, right)
        own = np.flatnonzero(labels != np.arange(len(labels)))
        signed = fps.view(np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(signed[own]), pa.array(signed[labels[own]])], names=["a", "b"]
        )

    for batch in batches:
        keys = np.concatenate([held_k, batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)])
        fps = np.concatenate(
            [held_f, batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)]
        )
        if not len(keys):
            continue
        whole = int(np.searchsorted(keys, keys[-1], "left"))
        if whole:
            yield links(keys[:whole], fps[:whole])
        held_k, held_f = keys[whole:], fps[whole:]
    if len(held_k):
        yield links(held_k, held_f)


def fingerprint_links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b) edges that connect all distinct fingerprints within ``max_bits`` of another.

    ``fps`` has one column of distinct signed longs. Each key's linked rows come
    out as a spanning forest, never as all pairs, so output is linear.
    """
    if not 0 <= max_bits < SEGMENTS:
        raise ValueError(f"max_bits must be 0 to {SEGMENTS - 1}")
    (name,) = fps.columns
    keyed = fps.select(
        F.explode(
            F.array(
                *[
                    F.shiftrightunsigned(name, i * WIDTH).bitwiseAND((1 << WIDTH) - 1)
                    + F.lit(i << WIDTH).cast("long")
                    for i in range(SEGMENTS)
                ]
            )
        ).alias("key"),
        F.col(name).alias("fp"),
    )
    return (
        keyed.repartition("key")
        .sortWithinPartitions("key")
        .mapInArrow(lambda it: _run_links(it, max_bits), "a long, b long")
    )


def near_duplicates(
    docs: DataFrame,
    max_bits: int = MAX_BITS,
    doc_id: str = "doc_id",
    text: str = "text",
    carry: list[str] | None = None,
) -> DataFrame:
    """Every row of ``docs`` with fingerprint, component_id and kept.

    ``carry`` names the columns to keep beside ``doc_id`` (all by default).

    component_id is the smallest id reachable over links; a null id is larger than
    any, and a group of null ids alone has a null component. ``kept`` is true for
    one row of each group: the smallest id, the first stored of equal ones. Empty,
    null and word-less texts share fingerprint 0 and are one group. The input
    columns ``_fp``, ``_row``, ``_keep``, ``fingerprint``, ``component_id`` and ``kept`` are
    replaced.
    """
    bounded_batches(docs.sparkSession)
    taken = {"_fp", "_row", "_keep", "fingerprint", "component_id", "kept"}
    wanted = docs.columns if carry is None else [doc_id, *(c for c in carry if c != doc_id)]
    marked = with_fingerprints(docs, [c for c in wanted if c not in taken], text)
    landed = land(marked.withColumn("_row", F.monotonically_increasing_id()), "simhash")
    ident = F.col(f"`{doc_id}`")
    groups = landed.groupBy("_fp").agg(
        F.min(ident).alias("_low"),
        F.min(F.struct(ident.isNull().alias("n"), ident.alias("i"), F.col("_row").alias("r"))).alias("_first"),
    )
    groups = land(groups, "fingerprints")
    linked = connected_components(fingerprint_links(groups.select("_fp"), max_bits))
    labelled = groups.join(linked, groups["_fp"] == linked["node"], "left").select(
        "_fp", "_low", "_first", F.coalesce("component", "_fp").alias("_label")
    )
    labelled = land(labelled, "labels")
    lowest = labelled.groupBy("_label").agg(
        F.min("_low").alias("component_id"), F.min("_first").alias("_first")
    )
    by_fp = land(
        labelled.select("_fp", "_label")
        .join(lowest, "_label")
        .select("_fp", "component_id", F.col("_first.r").alias("_keep")),
        "classes",
    )
    return (
        landed.join(by_fp, "_fp")
        .withColumn("fingerprint", F.lpad(F.lower(F.hex("_fp")), 16, "0"))
        .withColumn("kept", F.col("_row") == F.col("_keep"))
        .drop("_fp", "_row", "_keep")
    )
