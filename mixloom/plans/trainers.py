"""One entry to all trainers, their comparison and the scalability sweep."""

from __future__ import annotations

import time
import uuid
from functools import reduce

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from mixloom.model import Mixture, as_mixture
from mixloom.operators.augment import augment
from mixloom.operators.report import component_report
from mixloom.operators.scaling import (
    Scales,
    compute_scales,
    fix_scales,
    minmax_scale,
)
from mixloom.operators.starts import initial_mixture, sample_starts
from mixloom.plans.blocks import XY, packed, sum_many
from mixloom.plans.em import FitResult, Rounds, em_rounds, fit_em, run_together
from mixloom.plans.kmeans import fit_em_warm, fit_kmeans, kmeans_rounds, warm_rounds
from mixloom.plans.minibatch import fit_minibatch
from mixloom.plans.mllib import fit_mllib
from mixloom.schemas import RUNS

TRAINERS = {
    "em": fit_em,
    "em_mllib": fit_mllib,
    "sgd": fit_minibatch,
    "kmeans": lambda points, start, **o: fit_kmeans(points, start=as_mixture(start), **o),
    "em_warm": lambda points, start, **o: fit_em_warm(
        points, start=as_mixture(start), **o
    ),
}

# Trainers whose passes over the points can be shared.
ROUNDS = {"em": em_rounds, "kmeans": kmeans_rounds, "em_warm": warm_rounds}

# Names of single-machine variants that compute the same fit.
ALIASES = {"seq": "em", "par": "em", "rdd": "em", "mllib": "em_mllib"}


def resolve_trainer(name: str) -> str:
    known = ALIASES.get(name, name)
    if known not in TRAINERS:
        raise ValueError(
            f"unknown trainer {name!r}; choose among {sorted([*TRAINERS, *ALIASES])}"
        )
    return known


def fit(
    points: DataFrame, trainer: str, start: Mixture | DataFrame, **options
) -> FitResult:
    """Fit with the named trainer from a given start."""
    return TRAINERS[resolve_trainer(trainer)](points, start, **options)


def _timed(rounds: Rounds):
    begun = time.perf_counter()
    result = yield from rounds
    return result, time.perf_counter() - begun


def fit_all(
    points: DataFrame, fits: list[tuple[str, Mixture | DataFrame, dict]], cols=XY
) -> list[tuple[FitResult, float]]:
    """Fits ``(trainer, start, options)`` of the same points, each with its seconds.

    The points are packed once. Fits by EM, k-means and warm EM go over them together:
    each pass sums for every fit that still goes on, so there are as many jobs as the
    longest of them has passes, and their seconds count from the common begin. Other
    trainers run one after another. If fits fail the others are finished, and the
    first error is raised.
    """
    names = [resolve_trainer(name) for name, _, _ in fits]
    shared = [i for i, name in enumerate(names) if name in ROUNDS]
    results: list = [None] * len(fits)
    with packed(points, cols) as blocks:
        rounds = [_timed(ROUNDS[names[i]](as_mixture(fits[i][1]), **fits[i][2])) for i in shared]
        for i, result in zip(shared, run_together(blocks, rounds)):
            results[i] = result
    for i, (_, start, options) in enumerate(fits):
        if i not in shared:
            begun = time.perf_counter()
            results[i] = fit(points, names[i], start, cols=cols, **options), time.perf_counter() - begun
    for result in results:
        if isinstance(result, ValueError):
            raise result
    return results


def compare_trainers(
    points: DataFrame,
    trainers: list[str],
    start: Mixture | DataFrame,
    scales: Scales,
    options: dict[str, dict] | None = None,
) -> DataFrame:
    """Reports of all trainers from one start, matched by the rank of a component.

    ``(trainer, rank, component, weight, mean, cov, seconds)``; see ``fit_all``.
    """
    spark = points.sparkSession
    start = as_mixture(start)
    results = fit_all(points, [(name, start, (options or {}).get(name, {})) for name in trainers])
    return reduce(
        DataFrame.unionByName,
        [
            component_report(result.model_df(spark), scales).select(
                F.lit(name).alias("trainer"), "*", F.lit(seconds).alias("seconds")
            )
            for name, (result, seconds) in zip(trainers, results)
        ],
    )


def sweep(
    points: DataFrame,
    grid: list[Row] | list[dict],
    seed: int,
    options: dict[str, dict] | None = None,
    id_col: str = "point_id",
    cols: tuple[str, str] = XY,
) -> DataFrame:
    """Run every ``{trainer, k, aug}`` of the grid; one row per fit (schema RUNS).

    The points of an augmentation level are augmented, scaled and cached once
    and serve all its fits, which share their passes; see ``fit_all``. Points with
    NULL coordinates, a constant axis included, are refused by the fits.
    """
    spark = points.sparkSession
    wanted = [g.asDict() if isinstance(g, Row) else dict(g) for g in grid]
    for g in wanted:
        resolve_trainer(g["trainer"])
    rows = []
    for aug in sorted({g["aug"] for g in wanted}):
        copies = augment(points, aug, seed, cols, id_col)
        copies = copies.withColumn(
            id_col, F.col(id_col) * F.lit(aug + 1) + F.col("copy")
        )
        scaled = (
            minmax_scale(copies, fix_scales(compute_scales(copies, cols)), cols)
            .select(id_col, *cols).persist()
        )
        n_points = scaled.count()
        own = [g for g in wanted if g["aug"] == aug]
        starts = {
            k: initial_mixture(sample_starts(scaled, k, seed, cols, id_col), k, cols)
            for k in sorted({g["k"] for g in own})
        }
        with packed(scaled, cols) as blocks:
            fits = [(g["trainer"], starts[g["k"]], (options or {}).get(g["trainer"], {})) for g in own]
            alone = any(resolve_trainer(name) not in ROUNDS for name, _, _ in fits)
            results = fit_all(scaled if alone else blocks, fits, cols)
            closing = sum_many(blocks, [(result.mixture, False) for result, _ in results])
        for g, (result, seconds), sums in zip(own, results, closing):
            rows.append(
                (
                    uuid.uuid4().hex,
                    g["trainer"],
                    g["k"],
                    aug,
                    seed,
                    spark.sparkContext.master,
                    n_points,
                    result.epochs,
                    sums.total,
                    seconds,
                )
            )
        scaled.unpersist()
    return spark.createDataFrame(rows, RUNS)
