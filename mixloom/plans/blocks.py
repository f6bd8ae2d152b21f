"""Packed points and the single aggregation every trainer is built on."""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixloom.functions import kernels
from mixloom.model import DegenerateComponent, Mixture
from mixloom.operators.vectors import is_array
from mixloom.session import discard, landing_path

XY = ("x", "y")

# bytes of blocks that are handed to a Python task at once
PASS_BYTES = 8 << 20


def coordinates(points: DataFrame, cols=XY) -> DataFrame:
    """The coordinate columns alone, as doubles (or one array of doubles)."""
    if is_array(points, cols):
        return points.select(F.col(cols[0]).cast("array<double>").alias(cols[0]))
    return points.select(*[F.col(c).cast("double").alias(c) for c in cols])


def pack_points(points: DataFrame, cols=XY) -> DataFrame:
    """Points as rows of float64 blocks, one per Arrow batch. No shuffle.

    ``cols`` are numeric coordinate columns, or one ``array`` column. Packing
    once removes per-row work from every later pass over the points.
    """
    return coordinates(points, cols).mapInArrow(
        kernels.pack_batches, kernels.BLOCK_SCHEMA
    )


def for_one_pass(points: DataFrame, cols=XY) -> DataFrame:
    """What a single pass should read: packed blocks as they are, else the plain
    coordinates, which the pass folds without packing them first."""
    return points if points.columns == ["n", "block"] else coordinates(points, cols)


@contextmanager
def packed(
    points: DataFrame, cols=XY, storage: str = "memory", spread: int | None = None
):
    """Packed blocks kept for the length of a fit.

    ``memory`` caches them (spilling to disk); ``table`` lands them as Parquet
    in the shared folder, which also survives the loss of executors without
    recomputation; ``none`` re-reads and packs the source on each pass. A frame
    that is already packed is used as it is.

    ``spread`` deals the blocks out over that many partitions, for inputs that
    split badly (few row groups, compressed text). The blocks are landed before
    they are moved, so a task that is run again moves the very same blocks.
    """
    if points.columns == ["n", "block"]:
        yield points
        return
    if storage not in ("memory", "table", "none"):
        raise ValueError("storage must be 'memory', 'table' or 'none'")
    spark = points.sparkSession
    blocks = pack_points(points, cols)
    path = None
    try:
        if storage == "table" or spread is not None:
            path = landing_path(spark, "blocks")
            blocks.write.parquet(path)
            blocks = spark.read.schema(kernels.BLOCK_SCHEMA).parquet(path)
        if spread is not None:
            blocks = blocks.repartition(spread)
        if storage == "memory":
            blocks = blocks.persist(StorageLevel.MEMORY_AND_DISK)
        yield blocks
    finally:
        if storage == "memory":
            blocks.unpersist()
        if path is not None:
            discard(spark, path)


@contextmanager
def handed_in_parts(spark: SparkSession):
    """Passes in here hand blocks to Python some megabytes at a time.

    Spark's own bound counts rows, and a block is one row: a task would get all its
    points at once, copied at each growth of one buffer, and wait until they are all there.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(PASS_BYTES))
    try:
        yield
    finally:
        spark.conf.set(key, before)


class NoPoints(ValueError):
    """There was nothing to sum."""


@dataclass(frozen=True)
class Sums:
    """Sums over all points, un-whitened into offsets from the model's means."""

    count: int
    total: float
    weight: np.ndarray  # (K,)
    first: np.ndarray  # (K, d)    sum r * (x - mean)
    second: np.ndarray  # (K, d, d) sum r * (x - mean)(x - mean)'


def sum_many(blocks: DataFrame, models: list[tuple[Mixture, bool]]) -> list[Sums]:
    """One pass over the points for all models: per-task partial sums, then a sum by term.

    Each model comes with whether points are given to their nearest component only.
    Equal requests are summed once, such as those of k-means and of warm EM from one start.
    A task emits ``K * (1 + d + d(d+1)/2) + 2`` rows a model whatever its size, and the
    shuffle key has that many values, so no group grows with the data.
    """
    asked = [(m.weights.tobytes(), m.means.tobytes(), m.covs.tobytes(), hard) for m, hard in models]
    distinct = {key: request for key, request in zip(asked, models)}
    if len(distinct) < len(models):
        found = dict(zip(distinct, sum_many(blocks, list(distinct.values()))))
        return [found[key] for key in asked]
    arguments = []
    for model, hard in models:
        whiten, constant = model.whitening()
        arguments.append((whiten, model.means, constant, hard))
    with handed_in_parts(blocks.sparkSession):
        rows = (
            blocks.mapInArrow(kernels.fold_blocks(arguments), kernels.STATS_SCHEMA)
            .groupBy("model", "component", "term")
            .agg(F.sum("value").alias("value"))
            .toArrow()
        )
    if not rows.num_rows:
        raise NoPoints("there are no points to fit")
    number, component, term, value = (rows[c].to_numpy() for c in ("model", "component", "term", "value"))
    out = []
    for i, (model, _) in enumerate(models):
        own, whole = (number == i) & (component != kernels.WHOLE), np.zeros(2)
        table = np.zeros((model.k, 1 + model.d + model.d * (model.d + 1) // 2))
        table[component[own], term[own]] = value[own]
        rest = (number == i) & ~own
        whole[term[rest]] = value[rest]
        out.append(unwhitened(table, whole, model))
    return out


def sum_blocks(blocks: DataFrame, model: Mixture, hard: bool = False) -> Sums:
    """One pass over the points for one model."""
    return sum_many(blocks, [(model, hard)])[0]


def unwhitened(table: np.ndarray, whole: np.ndarray, model: Mixture) -> Sums:
    """A model's sums from the rows of its components and (log-likelihood, points)."""
    if not np.isfinite(table).all() or not np.isfinite(whole).all():
        raise ValueError("points hold NULL or NaN coordinates; filter them first")
    k, d = model.means.shape
    upper = np.triu_indices(d)
    packed_second = table[:, 1 + d :]
    second = np.zeros((k, d, d))
    second[:, upper[0], upper[1]] = packed_second
    second[:, upper[1], upper[0]] = packed_second
    factors = model.cholesky()
    return Sums(
        count=int(round(whole[1])),
        total=float(whole[0]),
        weight=table[:, 0],
        first=np.einsum("kij,kj->ki", factors, table[:, 1 : 1 + d]),
        second=factors @ second @ factors.transpose(0, 2, 1),
    )


def moments(sums: Sums, model: Mixture, reg_covar: float = 0.0) -> Mixture:
    """Weights, means and covariances (about the new means) from the sums."""
    empty = np.flatnonzero(sums.weight <= 0.0)
    if empty.size:
        raise DegenerateComponent(
            f"component {int(empty[0])} owns no share of any point"
        )
    offset = sums.first / sums.weight[:, None]
    covs = sums.second / sums.weight[:, None, None]
    covs = covs - offset[:, :, None] * offset[:, None, :]
    covs = covs + reg_covar * np.eye(model.d)
    return Mixture(sums.weight / sums.count, model.means + offset, covs)
