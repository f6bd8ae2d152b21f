"""k-means centres, and EM started from them."""

from __future__ import annotations

import time
from dataclasses import replace

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixloom.functions import kernels
from mixloom.model import DegenerateComponent, Mixture
from mixloom.operators.vectors import is_array, to_features, to_vectors
from mixloom.plans.blocks import XY, Sums, for_one_pass, packed, sum_blocks
from mixloom.plans.em import Epoch, FitResult, Rounds, em_rounds, run_alone, run_together
from mixloom.plans.seeding import seeded_centres

# rounds after which a search for centres that still move is given up
MAX_ROUNDS = 300


def _spheres(centres: np.ndarray) -> Mixture:
    """Unit spheres of equal weight: the likeliest one is the nearest centre."""
    return Mixture.at_points(centres)


def _moved(centres: np.ndarray, sums: Sums) -> np.ndarray:
    owned = np.maximum(sums.weight, 1.0)[:, None]
    # a centre without points stays where it is (its sums are zero)
    return centres + sums.first / owned


def inertia(sums: Sums) -> float:
    """Sum of squared distances to the nearest of the centres the pass used."""
    return float(np.trace(sums.second, axis1=1, axis2=2).sum())


def library_centres(
    points: DataFrame, k: int, seed: int = 0, cols=XY, max_iter: int = MAX_ROUNDS
) -> np.ndarray:
    """Centres from ``pyspark.ml`` KMeans (k-means|| start); packed points will do."""
    if points.columns == ["n", "block"]:
        prepared = points.mapInArrow(kernels.unpack_blocks, "features array<double>")
    elif is_array(points, cols):
        prepared = points.select(F.col(cols[0]).alias("features"))
    else:
        prepared = to_features(points, cols).select("features")
    # the estimator keeps its own cache of the vectors
    vectors = to_vectors(prepared).select("vector")
    fitted = KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="vector").fit(vectors)
    return np.array(fitted.clusterCenters())


def kmeans_step(points: DataFrame, centres, cols=XY) -> tuple[np.ndarray, float]:
    """One Lloyd step: new centres and the inertia under the given ones."""
    centres = np.asarray(centres, dtype=float)
    sums = sum_blocks(for_one_pass(points, cols), _spheres(centres), hard=True)
    return _moved(centres, sums), inertia(sums)


def kmeans_rounds(centres, max_iter: int = MAX_ROUNDS, tol: float = 1e-4) -> Rounds:
    """The rounds of ``fit_kmeans`` from given centres."""
    centres = np.asarray(centres.means if isinstance(centres, Mixture) else centres, dtype=float)
    history: list[Epoch] = []
    converged = False
    for epoch in range(1, max_iter + 1):
        begun = time.perf_counter()
        sums = yield _spheres(centres), True
        moved = _moved(centres, sums)
        history.append(Epoch(epoch, inertia(sums), time.perf_counter() - begun))
        shift = float(np.sqrt(((moved - centres) ** 2).sum(axis=1)).max())
        centres = moved
        if tol > 0 and shift <= tol:
            converged = True
            break
    closing = yield _spheres(centres), True
    mixture, count = _hard_mixture(closing, centres, 0.0)
    told = {"centres": centres, "inertia": inertia(closing)}
    return FitResult(mixture, history, count, converged, trainer="kmeans", extra=told)


def fit_kmeans(
    points: DataFrame,
    k: int | None = None,
    seed: int = 0,
    start=None,
    max_iter: int = MAX_ROUNDS,
    tol: float = 1e-4,
    cols=XY,
    storage: str = "memory",
    spread: int | None = None,
) -> FitResult:
    """k-means with hard-assignment weights and covariances as a mixture.

    Without ``start`` the centres come from ``pyspark.ml`` and are refined by
    Lloyd steps; with it, Lloyd steps run from the given centres. The steps end
    when no centre moves farther than ``tol`` (``tol=0``: after ``max_iter``).
    The history holds the inertia in place of the log-likelihood.
    """
    if start is None:
        if k is None:
            raise ValueError("give k or start centres")
        centres = library_centres(points, k, seed, cols)
    else:
        centres = start
    with packed(points, cols, storage, spread) as blocks:
        return run_alone(blocks, kmeans_rounds(centres, max_iter, tol))


def fit_kmeans_seeds(
    points: DataFrame,
    k: int,
    seeds: list[int],
    max_iter: int = MAX_ROUNDS,
    tol: float = 1e-4,
    cols=XY,
    storage: str = "memory",
    spread: int | None = None,
) -> FitResult:
    """The best of several k-means fits, each from centres that its seed draws.

    Seedings and Lloyd rounds of all seeds share their passes over one packed copy of the
    points; a fit that has converged leaves. The fit of least inertia under its final
    centres is given back (of equal ones that of the first seed); ``extra`` holds its seed,
    its inertia and those of all seeds.
    """
    with packed(points, cols, storage, spread) as blocks:
        centres = seeded_centres(blocks, k, seeds)
        fits = run_together(blocks, [kmeans_rounds(c, max_iter, tol) for c in centres])
    for fitted in fits:
        if isinstance(fitted, ValueError):
            raise fitted
    costs = [fitted.extra["inertia"] for fitted in fits]
    best = int(np.argmin(costs))
    told = {"seed": seeds[best], "inertia": costs[best], "inertias": dict(zip(seeds, costs))}
    return replace(fits[best], extra={**fits[best].extra, **told})


def _hard_mixture(sums: Sums, centres: np.ndarray, reg_covar: float) -> tuple[Mixture, int]:
    owned = np.maximum(sums.weight, 1.0)
    offset = sums.first / owned[:, None]
    covs = sums.second / owned[:, None, None] - offset[:, :, None] * offset[:, None, :]
    covs = covs + reg_covar * np.eye(centres.shape[1])
    return Mixture(sums.weight / sums.count, centres, covs), sums.count


def warm_start(
    points: DataFrame, centres, reg_covar: float = 1e-6, cols=XY
) -> Mixture:
    """The centres as means; weights and covariances of the nearest-centre groups."""
    centres = np.asarray(centres, dtype=float)
    sums = sum_blocks(for_one_pass(points, cols), _spheres(centres), hard=True)
    return _hard_mixture(sums, centres, reg_covar)[0]


def warm_rounds(
    start,
    kmeans_iter: int = MAX_ROUNDS,
    kmeans_tol: float = 1e-4,
    max_iter: int = 100,
    tol: float = 1e-5,
    reg_covar: float = 1e-6,
) -> Rounds:
    """The rounds of ``fit_em_warm`` from given centres."""
    nearest = yield from kmeans_rounds(start, kmeans_iter, kmeans_tol)
    hard = nearest.mixture
    empty = np.flatnonzero(hard.weights <= 0.0)
    if empty.size:
        raise DegenerateComponent(
            f"k-means centre {int(empty[0])} owns no point: start it elsewhere or ask for fewer"
        )
    warm = Mixture(hard.weights, hard.means, hard.covs + reg_covar * np.eye(hard.d))
    result = yield from em_rounds(warm, max_iter, tol, "mean", reg_covar)
    told = {"kmeans_converged": nearest.converged, "kmeans_epochs": nearest.epochs}
    return replace(result, trainer="em_warm", extra=told)


def fit_em_warm(
    points: DataFrame,
    k: int | None = None,
    seed: int = 0,
    start=None,
    kmeans_iter: int = MAX_ROUNDS,
    kmeans_tol: float = 1e-4,
    max_iter: int = 100,
    tol: float = 1e-5,
    reg_covar: float = 1e-6,
    cols=XY,
    storage: str = "memory",
    spread: int | None = None,
) -> FitResult:
    """EM started from k-means, stopped on the mean log-likelihood per point.

    Both fits run over the same packed points. ``converged`` tells of EM,
    ``extra`` whether k-means converged and in how many rounds. A centre without
    points raises before EM begins.
    """
    if start is None:
        if k is None:
            raise ValueError("give k or start centres")
        start = library_centres(points, k, seed, cols)
    with packed(points, cols, storage, spread) as blocks:
        return run_alone(
            blocks, warm_rounds(start, kmeans_iter, kmeans_tol, max_iter, tol, reg_covar)
        )
