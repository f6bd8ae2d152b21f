"""Start centres for k-means over packed points, several seedings by the same passes.

The scheme is that of scalable k-means++: a few rounds draw points by their squared
distance to what has been drawn, each drawn point is weighted with the points nearest to
it, and the few weighted points are clustered on the driver. A round draws a fixed number
of points, in one job for all seedings.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mixloom.functions import kernels
from mixloom.plans.blocks import NoPoints

ROUNDS = 4
OVERSAMPLE = 2.0


def _draw(blocks: DataFrame, draws: list[tuple]) -> list[np.ndarray]:
    """The first points of each race, over all tasks.

    A task gives up to ``most`` rows a draw. Spark limits each group before the rows of a
    draw meet, so that at most ``shuffle partitions * most`` of them do.
    """
    rows = blocks.mapInArrow(kernels.race_blocks(draws), kernels.RACE_SCHEMA)
    first = rows.groupBy("draw", "point").agg(F.min("time").alias("time"))
    most = max(m for _, _, m in draws)
    place = F.row_number().over(Window.partitionBy("draw").orderBy("time", "point"))
    won = first.withColumn("place", place).where(F.col("place") <= most).orderBy("draw", "place").collect()
    if any(r.draw == kernels.BAD for r in won):
        raise ValueError("points hold NULL or NaN coordinates; filter them first")
    return [np.array([r.point for r in won if r.draw == i], dtype=float) for i in range(len(draws))]


def _weights(blocks: DataFrame, sets: list[np.ndarray]) -> list[np.ndarray]:
    rows = (
        blocks.mapInArrow(kernels.count_nearest(sets), "draw int, centre int, n bigint")
        .groupBy("draw", "centre").agg(F.sum("n").alias("n"))
        .collect()
    )
    weights = [np.zeros(len(c)) for c in sets]
    for r in rows:
        weights[r.draw][r.centre] = r.n
    return weights


def cluster_weighted(
    points: np.ndarray, weights: np.ndarray, k: int, seed: int, tries: int = 8, rounds: int = 50
) -> np.ndarray:
    """k centres of a few weighted points: the best of several weighted k-means++ runs."""
    rng = np.random.default_rng(seed)
    best, least = None, np.inf
    for _ in range(tries):
        chosen = [int(rng.choice(len(points), p=weights / weights.sum()))]
        while len(chosen) < k:
            mass = weights * kernels._nearest(points.T, points[chosen])[1]
            if mass.sum() <= 0:  # the rest weighs nothing
                mass = np.where(np.isin(np.arange(len(points)), chosen), 0.0, 1.0)
            chosen.append(int(rng.choice(len(points), p=mass / mass.sum())))
        centres = points[chosen]
        for _ in range(rounds):
            label, _ = kernels._nearest(points.T, centres)
            owned = np.bincount(label, weights, k)
            sums = np.stack([np.bincount(label, weights * axis, k) for axis in points.T], axis=1)
            moved = np.where(owned[:, None] > 0, sums / np.maximum(owned, 1e-300)[:, None], centres)
            if np.array_equal(moved, centres):
                break
            centres = moved
        cost = float((weights * kernels._nearest(points.T, centres)[1]).sum())
        if cost < least:
            best, least = centres, cost
    return best


def seeded_centres(
    blocks: DataFrame, k: int, seeds: list[int], rounds: int = ROUNDS, oversample: float = OVERSAMPLE
) -> list[np.ndarray]:
    """k start centres for each seed, from packed points.

    There are ``rounds + 2`` jobs however many seeds: one draws a first point each, one
    for each round draws ``oversample * k`` points by their squared distance, one counts
    the points nearest to each drawn one. What comes to the driver are
    ``1 + rounds * oversample * k`` points a seed. Equal points are drawn once, with the
    weight of all copies in a block. Draws follow the blocks: the same packed blocks give
    the same centres, blocks of other sizes other ones, as good. Fewer distinct points than
    k raise, as does an empty input.
    """
    if k < 1 or not seeds:
        raise ValueError("k and the number of seeds must be at least 1")
    if rounds * oversample < 1:
        raise ValueError("rounds * oversample must be at least 1")
    most = int(np.ceil(oversample * k))
    mark = lambda seed, number: (seed * 1_000_003 + number) * 0x9E3779B9
    drawn = _draw(blocks, [(mark(s, 0), None, 1) for s in seeds])
    if not all(len(c) for c in drawn):
        raise NoPoints("there are no points to start from")
    for number in range(1, rounds + 1):
        more = _draw(blocks, [(mark(s, number), c, most) for s, c in zip(seeds, drawn)])
        if not any(len(m) for m in more):  # all distinct points are drawn
            break
        drawn = [np.vstack([c, m]) if len(m) else c for c, m in zip(drawn, more)]
    fewest = min(len(c) for c in drawn)
    if fewest < k:
        raise ValueError(f"only {fewest} distinct points for {k} centres")
    weights = _weights(blocks, drawn)
    return [cluster_weighted(c, w, k, s) for c, w, s in zip(drawn, weights, seeds)]
