"""A model that takes one mini-batch step for each micro-batch of a stream.

The model lives in a folder of versions, one for each micro-batch, and never in the
memory of the driver alone. A micro-batch that Spark hands out again after a failure finds
its version written and changes nothing; one whose version was not finished starts from
the version before it. So a stream that is killed and started again ends with the model
of a stream that ran through.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mixloom.model import Mixture, as_mixture
from mixloom.plans.blocks import XY, NoPoints, for_one_pass, sum_blocks
from mixloom.plans.minibatch import minibatch_update
from mixloom.schemas import MODEL_VERSION

_DONE = "_SUCCESS"
_FOLDER = "version="


@dataclass(frozen=True)
class Version:
    """The model after a micro-batch: its number, steps made so far, and what the step met.

    ``loglik`` is that of the batch under the model before the step; both it and
    ``points`` are of the last micro-batch that had points.
    """

    number: int
    step: int
    points: int
    loglik: float | None
    mixture: Mixture


def _folder(spark: SparkSession, store: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _path(store: str, number: int) -> str:
    return f"{store.rstrip('/')}/{_FOLDER}{number}"


def versions(spark: SparkSession, store: str) -> list[int]:
    """Numbers of the finished versions, in order. An unfinished one is not among them."""
    files, folder = _folder(spark, store)
    if not files.exists(folder):
        return []
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    names = [s.getPath().getName() for s in files.listStatus(folder)]
    numbers = sorted(int(n[len(_FOLDER) :]) for n in names if n.startswith(_FOLDER))
    return [n for n in numbers if files.exists(path(f"{_path(store, n)}/{_DONE}"))]


def read_version(spark: SparkSession, store: str, number: int | None = None) -> Version:
    """A finished version, by default the last one."""
    known = versions(spark, store)
    if not known or (number is not None and number not in known):
        raise ValueError(f"{store} has no finished version" + ("" if number is None else f" {number}"))
    number = known[-1] if number is None else number
    table = spark.read.schema(MODEL_VERSION).parquet(_path(store, number))
    told = table.select("step", "points", "loglik").first()
    return Version(number, told.step, told.points, told.loglik, Mixture.from_df(table))


def version_history(spark: SparkSession, store: str) -> DataFrame:
    """(version, step, points, loglik) of the finished versions that are still kept."""
    known = versions(spark, store)
    if not known:
        return spark.createDataFrame([], "version bigint, step bigint, points bigint, loglik double")
    table = spark.read.schema(MODEL_VERSION).parquet(*[_path(store, n) for n in known])
    return table.where("component = 0").select("version", "step", "points", "loglik")


def _write(spark: SparkSession, store: str, version: Version) -> None:
    rows = version.mixture.to_df(spark).select(
        F.lit(version.number).cast("bigint").alias("version"),
        F.lit(version.step).cast("bigint").alias("step"),
        F.lit(version.points).cast("bigint").alias("points"),
        F.lit(version.loglik).cast("double").alias("loglik"),
        "component", "weight", "mean", "cov",
    )
    # what a killed attempt left behind is replaced
    rows.coalesce(1).write.mode("overwrite").parquet(_path(store, version.number))


def step_stream(
    stream: DataFrame,
    start: Mixture | DataFrame,
    store: str,
    progress: str,
    rate: float = 0.5,
    decay: float = 100.0,
    cols=XY,
    keep: int = 1000,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Start a stream whose every micro-batch moves the model in ``store`` by one step.

    Step t (from 0) uses the rate ``rate / (1 + t / decay)``; a micro-batch without
    points makes no step. ``start`` counts only where ``store`` has no version yet, so
    the same call starts a stream and goes on with it. ``progress`` is the stream's
    checkpoint folder; both folders must be shared and belong together: a new
    ``progress`` over a used ``store`` would number its batches anew and is refused.

    Each micro-batch is one aggregation over its points, summed within tasks; only K rows
    come to the driver. A NULL or NaN coordinate or a component that loses its points
    ends the stream with an error, and the last version stays as it was. Only the last
    ``keep`` versions are kept. ``trigger`` holds the arguments of the stream's trigger,
    by default ``availableNow=True``.
    """
    if not 0 < rate <= 1:
        raise ValueError("rate must lie in (0, 1]")
    if keep < 2:
        raise ValueError("keep must be at least 2: a step needs the version before its own")
    spark = stream.sparkSession
    first = as_mixture(start)
    files, folder = _folder(spark, f"{progress.rstrip('/')}/offsets")
    if versions(spark, store) and not files.exists(folder):
        raise ValueError(f"{store} has versions of another stream than that of {progress}")

    def step(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        known = versions(own, store)
        if number in known or (known and known[-1] > number):
            return  # handed out again
        if known and known[-1] != number - 1:
            raise ValueError(f"{store} ends with version {known[-1]}, batch {number} cannot follow")
        if not known and number:
            raise ValueError(f"{store} has no version that batch {number} could follow")
        last = read_version(own, store, number - 1) if known else Version(-1, 0, 0, None, first)
        try:
            sums = sum_blocks(for_one_pass(batch, cols), last.mixture)
        except NoPoints:
            moved = Version(number, last.step, last.points, last.loglik, last.mixture)
        else:
            mixture = minibatch_update(last.mixture, sums, rate / (1 + last.step / decay))
            if not math.isfinite(sums.total):
                raise ValueError(f"batch {number} has no finite likelihood")
            moved = Version(number, last.step + 1, sums.count, sums.total, mixture)
        _write(own, store, moved)
        target, _ = _folder(own, store)
        for old in known[: max(0, len(known) + 1 - keep)]:
            target.delete(_folder(own, _path(store, old))[1], True)

    return (
        stream.writeStream.foreachBatch(step)
        .option("checkpointLocation", progress)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
