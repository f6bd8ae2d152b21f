"""Near-duplicate vectors by a forest of random-projection trees with spill.

Trees are built on the driver from a bounded sample and every row is routed through
all of them: a row near a cut goes to both sides. Rows of a leaf are compared in
full. A pair is counted only in the first leaf that both share, so counts add up
without writing pairs, and each leaf gives a spanning forest of its links.

A dense group (many copies that differ a little) fits in no small leaf. Rows within
half the linking angle of a common centre are all linked to each other, so such a
ball is counted by its size; its rows are dealt over several tasks, each of which
compares them with the other rows of the leaf only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixloom.llm.ann import dimension, valid_vectors
from mixloom.llm.common import join_labels, land
from mixloom.llm.components import connected_components

THRESHOLD = 0.9
TREES = 5
LEAF_ROWS = 2048
SAMPLE = 8192
MARGIN = 0.03
LEAF_SAMPLE = 16
BALL_SHARE = 1 / 256
SEED = 29
_SALT_BITS = 20
_ROWS = 512


@dataclass
class Tree:
    """Nodes as rows (direction, cut, left, right); a leaf has left = -1 - its number."""

    directions: np.ndarray
    cuts: np.ndarray
    children: np.ndarray
    root: int
    leaves: int

    def route(self, unit: np.ndarray, margin: float) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, rows) with rows near a cut on both sides."""
        todo = [(self.root, np.arange(len(unit)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if node < 0:
                yield -1 - node, rows
                continue
            side = unit[rows] @ self.directions[node] - self.cuts[node]
            todo.append((int(self.children[node, 0]), rows[side <= margin]))
            todo.append((int(self.children[node, 1]), rows[side >= -margin]))


def grow_tree(sample: np.ndarray, leaf: float, margin: float, rng: np.random.Generator) -> Tree:
    """Cut the sample until a node holds ``leaf`` points or no cut parts it.

    Of a few random directions and quantiles that cut is taken which leaves the
    least in its larger side, spilled points included: it falls into gaps.
    """
    directions, cuts, children = [], [], []
    leaves = 0

    def grow(rows: np.ndarray) -> int:
        nonlocal leaves
        if len(rows) > leaf:
            tries = rng.standard_normal((8, sample.shape[1]))
            tries /= np.linalg.norm(tries, axis=1)[:, None]
            spots = sample[rows] @ tries.T
            best = None
            for j in range(len(tries)):
                ordered = np.sort(spots[:, j])
                for cut in np.quantile(ordered, (0.1, 0.3, 0.4, 0.5, 0.6, 0.7, 0.9)):
                    left = np.searchsorted(ordered, cut + margin, "right")
                    right = len(rows) - np.searchsorted(ordered, cut - margin, "left")
                    cost = max(left, right) + 0.5 * (left + right)
                    if max(left, right) <= 0.95 * len(rows) and (best is None or cost < best[0]):
                        best = (cost, j, cut)
            if best is not None:
                _, j, cut = best
                node = len(directions)
                directions.append(tries[j])
                cuts.append(cut)
                children.append([0, 0])
                side = spots[:, j] - cut
                children[node] = [grow(rows[side <= margin]), grow(rows[side >= -margin])]
                return node
        leaves += 1
        return -leaves

    root = grow(np.arange(len(sample)))
    d = sample.shape[1]
    return Tree(
        np.array(directions).reshape(-1, d), np.array(cuts), np.array(children).reshape(-1, 2), root, leaves
    )


def dense_centres(sample: np.ndarray, half: float, least: int) -> np.ndarray:
    """Sample points with ``least`` or more others within the half angle, densest first."""
    counts = np.zeros(len(sample), np.int64)
    for at in range(0, len(sample), _ROWS):
        counts[at : at + _ROWS] = (sample[at : at + _ROWS] @ sample.T >= half).sum(1)
    free = counts >= max(least, 2)
    centres = []
    while free.any():
        top = int(np.argmax(np.where(free, counts, 0)))
        near = sample @ sample[top] >= half
        centres.append(sample[top])
        free &= ~near
        free[top] = False
    return np.array(centres).reshape(-1, sample.shape[1])


@dataclass
class Forest:
    trees: list[Tree]
    centres: np.ndarray
    half: float
    margin: float
    #: by cell: the ball that is dealt out, and over how many tasks
    hosts: dict[int, tuple[int, int]]

    @property
    def offsets(self) -> np.ndarray:
        return np.cumsum([0, *(t.leaves for t in self.trees)])

    def ball_of(self, unit: np.ndarray) -> np.ndarray:
        """The nearest centre within the half angle, or -1."""
        if not len(self.centres):
            return np.full(len(unit), -1)
        near = unit @ self.centres.T
        best = near.argmax(1)
        return np.where(near[np.arange(len(unit)), best] >= self.half, best, -1)

    def cells(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) sorted by row and cell; cells are numbered through all trees."""
        rows, cells = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for tree, offset in zip(self.trees, self.offsets):
            for leaf, own in tree.route(unit, self.margin):
                rows.append(own)
                cells.append(np.full(len(own), offset + leaf))
        row, cell = np.concatenate(rows), np.concatenate(cells)
        order = np.lexsort((cell, row))
        return row[order], cell[order]


def grow_forest(sample: np.ndarray, total: int, threshold: float, trees: int, leaf_rows: int, margin: float) -> Forest:
    rng = np.random.default_rng(SEED)
    leaf = max(LEAF_SAMPLE, leaf_rows * len(sample) / max(total, 1))
    half = float(np.cos(np.arccos(threshold) / 2)) + 1e-9
    forest = Forest(
        [grow_tree(sample, leaf, margin, rng) for _ in range(trees)],
        dense_centres(sample, half, int(len(sample) * BALL_SHARE)),
        half,
        margin,
        {},
    )
    row, cell = forest.cells(sample)
    ball = forest.ball_of(sample)[row]
    for c in np.unique(cell[ball >= 0]) if (ball >= 0).any() else ():
        names, counts = np.unique(ball[(cell == c) & (ball >= 0)], return_counts=True)
        expected = counts.max() * total / len(sample)
        forest.hosts[int(c)] = (int(names[counts.argmax()]), max(1, round(expected / leaf_rows)))
    return forest


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)  # squares stay finite
    return scaled / np.linalg.norm(scaled, axis=1)[:, None]


def _route(batches: Iterator[pa.RecordBatch], forest: Forest, d: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rep = batch.column(0).to_numpy(zero_copy_only=False)
        n = batch.column(1).to_numpy(zero_copy_only=False)
        vectors = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
        unit = unit_rows(vectors)
        ball = forest.ball_of(unit)
        row, cell = forest.cells(unit)
        starts = np.searchsorted(row, np.arange(len(rep) + 1))
        lists = [cell[a:b].astype("<i4").tobytes() for a, b in zip(starts, starts[1:])]
        if not len(row):
            continue
        out_row, out_cell, role = [], [], []
        for r, c in zip(row.tolist(), cell.tolist()):
            host, salts = forest.hosts.get(c, (-1, 1))
            if salts > 1 and ball[r] != host:
                for s in range(salts):  # meets the host ball in each of its tasks
                    out_row.append(r)
                    out_cell.append((c << _SALT_BITS) | s)
                    role.append(0)
            else:
                out_row.append(r)
                out_cell.append((c << _SALT_BITS) | (int(rep[r]) * 2654435761 >> 7) % salts)
                role.append(int(salts > 1))
        take = np.array(out_row)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(out_cell, pa.int64()),
                pa.array(role, pa.int32()),
                pa.array(rep[take]),
                pa.array(n[take]),
                pa.array(ball[take].astype(np.int32)),
                pa.array([lists[r] for r in out_row], pa.binary()),
                pa.array([vectors[r].tobytes() for r in out_row], pa.binary()),
            ],
            names=["cell", "role", "rep", "n", "ball", "cells", "v"],
        )


def compare_cell(cell: int, role, rep, n, ball, cells, unit, threshold: float) -> tuple:
    """Weighted links of each row that are counted in this cell, and labels of linked rows."""
    own, salt = cell >> _SALT_BITS, cell & ((1 << _SALT_BITS) - 1)
    earlier = sorted({c for x in cells for c in x.tolist() if c < own})
    place = {c: i for i, c in enumerate(earlier)}
    member = np.zeros((len(rep), max(len(earlier), 1)), np.float32)
    for r, x in enumerate(cells):
        for c in x.tolist():
            if c < own:
                member[r, place[c]] = 1
    links = np.zeros(len(rep), np.int64)
    labels = np.arange(len(rep))
    guests = role == 0
    for at in range(0, len(rep), _ROWS):
        part = slice(at, min(at + _ROWS, len(rep)))
        near = unit[part] @ unit.T >= threshold
        near[np.arange(part.stop - at), np.arange(at, part.stop)] = False
        near &= (ball[part, None] < 0) | (ball[part, None] != ball[None, :])
        if salt:  # rows that are in every salt meet each other in the first
            near &= ~(guests[part, None] & guests[None, :])
        if not near.any():
            continue
        near &= (member[part] @ member.T) == 0
        links[part] += near @ n
        left, right = np.nonzero(near)
        join_labels(labels, left + at, right)
    return links, labels


def _compare(batches: Iterator[pa.RecordBatch], threshold: float, dtype, d: int) -> Iterator[pa.RecordBatch]:
    def whole(parts):
        batch = pa.Table.from_batches(parts).combine_chunks()
        cell = batch["cell"][0].as_py()
        role, rep, n, ball = (
            batch[c].to_numpy().astype(np.int64) for c in ("role", "rep", "n", "ball")
        )
        cells = [np.frombuffer(x.as_py(), "<i4") for x in batch["cells"]]
        vectors = np.stack([np.frombuffer(x.as_py(), dtype) for x in batch["v"]]).astype(np.float64)
        links, labels = compare_cell(cell, role, rep, n, ball, cells, unit_rows(vectors), threshold)
        some = np.flatnonzero(links > 0)
        return pa.RecordBatch.from_arrays(
            [pa.array(rep[some]), pa.array(links[some]), pa.array(rep[labels[some]])],
            names=["rep", "links", "to"],
        )

    held: list[pa.RecordBatch] = []
    for batch in batches:
        cell = batch.column("cell").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if held and held[0].column("cell")[0].as_py() != cell[a]:
                yield whole(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield whole(held)


def near_duplicate_vectors(
    df: DataFrame,
    threshold: float = THRESHOLD,
    trees: int = TREES,
    leaf_rows: int = LEAF_ROWS,
    margin: float = MARGIN,
    sample: int = SAMPLE,
    vec_id: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Rows link when their cosine is at least ``threshold`` (above 0). Null, zero and
    non-finite vectors, vectors of another length than the most frequent one and
    rows with a null id link with nothing; such a row is its own component and a
    null id is not kept. Rows that repeat an id are vectors of their own and count
    as links of each other. Equal vectors are compared once and counted by number.
    """
    if not 0 < threshold < 1:
        raise ValueError("threshold must lie between 0 and 1")
    ids = F.col(f"`{vec_id}`").cast("long")
    floats = dict(df.dtypes)[vector] == "array<float>"
    rows = valid_vectors(df, vec_id, vector)
    d = dimension(rows)
    rows = rows.where(F.size("v") == d)
    if floats:
        rows = rows.withColumn("v", F.col("v").cast("array<float>"))
    everyone = df.select(ids.alias("vec_id"))
    if not d:
        linked = df.sparkSession.createDataFrame([], "vec_id long, n_links long, component_id long")
        return _with_lone(everyone, linked)
    distinct = land(
        rows.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")).select("rep", "n", "v"),
        "vectors",
    )
    total = distinct.count()
    drawn = distinct.select(F.xxhash64("rep", "v").alias("h"), "v").orderBy("h").limit(sample).select("v")
    points = unit_rows(np.array([r.v for r in drawn.collect()], np.float64))
    forest = grow_forest(points, total, threshold, trees, leaf_rows, margin)
    shared = df.sparkSession.sparkContext.broadcast(forest)  # bounded by the sample
    dtype = "<f4" if floats else "<f8"

    cells = distinct.mapInArrow(
        lambda it: _route(it, shared.value, d),
        "cell long, role int, rep long, n long, ball int, cells binary, v binary",
    )
    found = land(
        cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(
            lambda it: _compare(it, threshold, dtype, d), "rep long, links long, to long"
        ),
        "links",
    )

    def balls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            ball = shared.value.ball_of(unit_rows(vectors)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(ball)], names=["rep", "n", "ball"])

    in_ball = land(distinct.mapInArrow(balls, "rep long, n long, ball int"), "balls")
    sums = (
        in_ball.where("ball >= 0").groupBy("ball")
        .agg(F.sum("n").alias("in_ball"), F.min("rep").alias("first"))
    )
    per_row = (
        in_ball.join(F.broadcast(sums), "ball", "left")  # one row per centre of the sample
        .select("rep", F.coalesce("in_ball", "n").alias("own"), "first")
    )
    edges = found.select(F.col("rep").alias("a"), F.col("to").alias("b")).union(
        per_row.where("first is not null").select("rep", "first")
    )
    labels = connected_components(edges)
    counted = (
        per_row.join(found.groupBy("rep").agg(F.sum("links").alias("links")), "rep", "left")
        .join(labels, F.col("rep") == F.col("node"), "left")
        .select(
            "rep",
            (F.col("own") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce("component", "rep").alias("component_id"),
        )
    )
    with_v = land(counted.join(distinct.select("rep", "v"), "rep"), "counted")
    linked = rows.join(with_v.select("v", "n_links", "component_id"), "v").select(
        "vec_id", "n_links", "component_id"
    )
    dropped = df.select(ids.alias("vec_id"), F.col(f"`{vector}`").alias("v"))
    lone = _lone(dropped, d)
    return _result(linked.unionByName(lone))


def _lone(rows: DataFrame, d: int) -> DataFrame:
    """Rows that cannot link with any other."""
    v = F.col("v").cast("array<double>")
    fine = (
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size(v) == d)
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(v, lambda x: x != 0)
    )
    return rows.where(~F.coalesce(fine, F.lit(False))).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )


def _with_lone(everyone: DataFrame, linked: DataFrame) -> DataFrame:
    lone = everyone.select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return _result(linked.unionByName(lone))


def _result(rows: DataFrame) -> DataFrame:
    same = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    return rows.withColumn("kept", same)
