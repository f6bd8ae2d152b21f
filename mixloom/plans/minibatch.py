"""Stochastic mini-batch fit.

A step moves the model along one batch of bounded size, and the next step needs that
model: steps cannot run side by side. So a run of steps is one job that cuts their
points out of the whole table in parallel, packs them by step and hands the blocks, a
bounded number of points, to one task that makes the steps one after another. Only where a single step is much work is it
a job of its own, over landed batches.
"""

from __future__ import annotations

import math
import sys
import time
from collections.abc import Callable
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixloom.functions import kernels
from mixloom.functions.columns import digest_word, seeded_digest
from mixloom import model as model_module
from mixloom.model import DegenerateComponent, Mixture, as_mixture
from mixloom.plans import blocks as blocks_module
from mixloom.plans.blocks import XY, NoPoints, Sums, coordinates, sum_blocks, unwhitened
from mixloom.plans.em import Epoch, FitResult
from mixloom.session import discard, landing_path

# Fixed values of the benchmark set-up.
BATCH_SIZE = 131_072
STEPS = 2_500
# batches landed by one pass over the points
WAVE = 4_096
SMALL_WAVE = 128
# points of a batch that one task packs
SLICE = 65_536
# longest run of steps, and numbers that its task may hold
RUN = 1_024
HELD = 1 << 25
# products of a step from which it is worth a job of its own
HEAVY = 1 << 28


def _land_batches(
    points: DataFrame,
    coords: list[str],
    id_col: str,
    seed: int,
    n_batches: int,
    slices: int,
    first: int,
    last: int,
    path: str,
) -> None:
    """Cut out the batches of steps ``first .. last - 1`` by one pass and land them.

    In epoch e, step ``e * n_batches + b`` takes the points whose hash of id, seed
    and e falls on b.
    """
    epochs = first // n_batches, (last - 1) // n_batches
    dealt = points.select(F.col(id_col).alias("_id"), *coords).withColumn(
        "_epoch",
        F.lit(epochs[0])
        if epochs[0] == epochs[1]
        else F.explode(F.sequence(F.lit(epochs[0]), F.lit(epochs[1]))),
    )
    batch = digest_word(seeded_digest(F.col("_id"), seed, F.col("_epoch")), 0) % n_batches
    blocks = (
        dealt.select(
            (F.col("_epoch").cast("bigint") * n_batches + batch).alias("key"),
            F.pmod(F.xxhash64("_id"), F.lit(slices)).alias("_slice"),
            *coords,
        )
        .filter(F.col("key").between(first, last - 1))
        .repartition("key", "_slice")
        .sortWithinPartitions("key")
        .select("key", *coords)
        .mapInArrow(kernels.pack_keyed_batches, kernels.KEYED_BLOCK_SCHEMA)
    )
    blocks.write.partitionBy("key").parquet(path)


def minibatch_update(model: Mixture, sums: Sums, rate: float) -> Mixture:
    """Move the model by ``rate`` along one batch's sums.

    Means take a gradient step; covariances a convex mix with the batch's second
    moments, so they stay positive for ``rate <= 1``; weights step in logit space.
    """
    share = sums.weight / sums.count
    means = model.means + rate * sums.first / sums.count
    covs = (1 - rate * share)[:, None, None] * model.covs + rate * sums.second / sums.count
    logits = np.log(model.weights) + rate * (share - model.weights)
    weights = np.exp(logits - logits.max())
    return Mixture(weights / weights.sum(), means, covs)


def _step_task(start: Mixture, first: int, last: int, n_batches: int, rate: float, decay: float):
    """Task function: steps ``first .. last - 1`` from ``start``, one after another.

    Rows are packed blocks in the order of their steps; those of one step are held at a time.
    """

    def run(batches):
        model, told, error, seen = start, [], None, False
        for key, points in kernels.by_key(batches):
            seen = True
            # a single batch is the same in every epoch
            for step in (key,) if n_batches > 1 else range(first, last):
                if error is not None:  # what is left is only read
                    break
                try:
                    whiten, constant = model.whitening()
                except DegenerateComponent as reason:
                    error = str(reason)
                    break
                fold = kernels.Fold(whiten, model.means, constant, False)
                fold.add(points)
                found = unwhitened(fold.table(), np.array([fold.total, fold.count]), model)
                model = minibatch_update(model, found, rate / (1 + step / decay))
                told.append((step + 1, found.total))
        if not seen:
            return
        values = np.concatenate([model.weights, model.means.ravel(), model.covs.ravel()])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([[s for s, _ in told]], pa.list_(pa.int64())),
                pa.array([[t for _, t in told]], pa.list_(pa.float64())),
                pa.array([values.tolist()], pa.list_(pa.float64())),
                pa.array([error], pa.string()),
            ],
            names=["steps", "totals", "model", "error"],
        )

    return run


def _run_length(n_points: int, batch_size: int, n_batches: int, d: int) -> int:
    """Steps whose points, with a step number for each epoch, a task can hold."""
    run = RUN
    while run > 1 and n_batches > 1 and min(n_points, run * batch_size) * (d + run // n_batches + 2) > HELD:
        run //= 2
    return run


def _run_steps(
    points: DataFrame, coords: list[str], id_col: str, seed: int, n_batches: int, model: Mixture,
    first: int, last: int, rate: float, decay: float,
):
    """Steps ``first .. last - 1`` in one job: (model, [(step, loglik)], error or None).

    Many tasks find the steps of the points and pack the points of a step into blocks;
    one task takes the blocks in the order of their steps. All points of a task go to that
    one task at once, so a task that is run again changes nothing.
    """
    if n_batches == 1:
        dealt = points.select(F.lit(first).cast("bigint").alias("key"), *coords)
    else:
        epochs = F.sequence(F.lit(first // n_batches), F.lit((last - 1) // n_batches))
        batch = digest_word(seeded_digest(F.col("_id"), seed, F.col("_epoch")), 0) % n_batches
        dealt = (
            points.select(F.col(id_col).alias("_id"), *coords)
            .withColumn("_epoch", F.explode(epochs))
            .select((F.col("_epoch").cast("bigint") * n_batches + batch).alias("key"), *coords)
        )
    # points of other runs are left out there: a filter would hash every point twice
    blocks = dealt.mapInArrow(kernels.pack_keyed_runs(first, last), kernels.KEYED_BLOCK_SCHEMA)
    schema = "steps array<bigint>, totals array<double>, model array<double>, error string"
    task = _step_task(model, first, last, n_batches, rate, decay)
    rows = blocks.repartition(1).sortWithinPartitions("key").mapInArrow(task, schema).collect()
    if not rows:
        return model, [], None
    k, d = model.means.shape
    weights, means, covs = np.split(np.array(rows[0].model), [k, k + k * d])
    moved = Mixture(weights, means.reshape(k, d), covs.reshape(k, d, d))
    return moved, list(zip(rows[0].steps, rows[0].totals)), rows[0].error


@contextmanager
def _dealt_out(points: DataFrame, coords: list[str], id_col: str, uneven: bool):
    """The points; if ``uneven``, dealt out over all cores and kept.

    Each run hashes all points, so an input of few row groups would keep few cores busy.
    """
    if not uneven:
        yield points
        return
    columns = list(dict.fromkeys([id_col, *coords]))
    cores = points.sparkSession.sparkContext.defaultParallelism
    kept = points.select(*columns).repartition(cores, *columns).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield kept
    finally:
        kept.unpersist()


def fit_minibatch(
    points: DataFrame,
    start: Mixture | DataFrame,
    steps: int = STEPS,
    batch_size: int = BATCH_SIZE,
    rate: float = 0.5,
    decay: float = 100.0,
    seed: int = 0,
    cols=XY,
    id_col: str = "point_id",
    first: int = 0,
    steps_per_job: int | None = None,
    on_run: Callable[[int, Mixture], None] | None = None,
) -> FitResult:
    """Step through hashed batches; step t uses the rate ``rate / (1 + t / decay)``.

    Passing over all the data once takes ``ceil(n / batch_size)`` steps, and a new epoch
    deals the points anew. ``steps_per_job`` steps are one job: a pass over the points
    picks and packs those of these steps, and one task makes the steps. How many
    that are by default follows from the batch size (64 steps of 131,072 points in two
    dimensions, at most 1,024), never from the size of the table.

    ``steps_per_job=1``, the default for models so large that a step is much work, lands
    the batches of many steps as packed blocks in a folder per batch; each step is a job
    that reads its own folder with many tasks. Both give the same models.

    ``on_run`` sees the number of steps done and the model after each job (or step), e.g. to
    save it; with that model as ``start`` and the number as ``first`` a fit goes on where
    it was.
    """
    if not 0 < rate <= 1:
        raise ValueError("rate must lie in (0, 1]")
    if steps_per_job is not None and steps_per_job < 1:
        raise ValueError("steps_per_job must be at least 1")
    model = as_mixture(start)
    spark = points.sparkSession
    held = points.groupBy(F.spark_partition_id()).count().agg(F.sum("count"), F.max("count")).first()
    n_points, largest = (n or 0 for n in held)
    n_batches = max(1, math.ceil(n_points / batch_size))
    coords = coordinates(points, cols).columns
    history: list[Epoch] = []
    # small data come round often: cut several epochs out at once, but not too many
    wave = WAVE if n_batches >= WAVE else max(n_batches, SMALL_WAVE)
    step = first
    if steps_per_job is None:
        heavy = min(batch_size, n_points) * model.k * model.d**2 > HEAVY
        steps_per_job = 1 if heavy else _run_length(n_points, batch_size, n_batches, model.d)
    # several runs over points of which a core would hash more than twice its share
    uneven = 1 < steps_per_job < steps - step and largest * spark.sparkContext.defaultParallelism > 2 * n_points
    with _dealt_out(points, coords, id_col, uneven) as source:
        while step < steps and steps_per_job > 1:
            last, begun = min(step + steps_per_job, steps), time.perf_counter()
            model, told, error = _run_steps(
                source, coords, id_col, seed, n_batches, model, step, last, rate, decay
            )
            each = (time.perf_counter() - begun) / (last - step)
            history += [Epoch(number, total, each) for number, total in told]
            if error is not None:
                raise DegenerateComponent(
                    f"after step {history[-1].epoch if history else step}: {error}", model, history
                )
            step = last
            if on_run is not None:
                on_run(step, model)
    while step < steps and steps_per_job == 1:
        last = min(step + wave, steps)
        path = landing_path(spark, "batches")
        try:
            _land_batches(
                points, coords, id_col, seed, n_batches, math.ceil(batch_size / SLICE), step, last, path
            )
            landed = spark.read.schema(kernels.KEYED_BLOCK_SCHEMA).parquet(path)
            for number in range(step, last):
                begun = time.perf_counter()
                step += 1
                try:
                    own = landed.filter(F.col("key") == number).select("n", "block")
                    sums = sum_blocks(own, model)
                except NoPoints:  # the hash dealt this batch nothing
                    continue
                model = minibatch_update(model, sums, rate / (1 + (step - 1) / decay))
                history.append(Epoch(step, sums.total, time.perf_counter() - begun))
                if on_run is not None:
                    on_run(step, model)
        finally:
            discard(spark, path)
    return FitResult(model, history, n_points, trainer="sgd")


# the tasks' helpers travel with them: executors need no installed copy
for _module in (sys.modules[__name__], model_module, blocks_module):
    cloudpickle.register_pickle_by_value(_module)
