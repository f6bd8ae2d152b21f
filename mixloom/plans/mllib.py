"""The library's EM, from a given start."""

from __future__ import annotations

import time
from types import SimpleNamespace

import numpy as np
from pyspark.mllib.clustering import GaussianMixture
from pyspark.mllib.linalg import DenseMatrix, DenseVector, Vectors
from pyspark.mllib.stat.distribution import MultivariateGaussian
from pyspark.sql import DataFrame

from mixloom.model import Mixture, as_mixture
from mixloom.plans.blocks import XY, pack_points
from mixloom.plans.em import Epoch, FitResult, log_likelihood


def _library_model(model: Mixture) -> SimpleNamespace:
    """What the trainer reads of an initial model: size, weights, Gaussians."""
    gaussians = [
        MultivariateGaussian(
            Vectors.dense(m), DenseMatrix(model.d, model.d, c.ravel(order="F"))
        )
        for m, c in zip(model.means, model.covs)
    ]
    return SimpleNamespace(k=model.k, weights=model.weights.tolist(), gaussians=gaussians)


def fit_mllib(
    points: DataFrame,
    start: Mixture | DataFrame,
    max_iter: int = 50,
    tol: float = 0.0,
    seed: int = 0,
    cols=XY,
    final_loglik: bool = False,
) -> FitResult:
    """``pyspark.mllib`` GaussianMixture from the given start.

    The DataFrame API of the library takes no start, hence its RDD API. Vectors
    are made from packed blocks, which spares the conversion of single rows.
    """
    model = as_mixture(start)

    def vectors(row):
        block = np.frombuffer(row.block, dtype="float64").reshape(-1, row.n)
        return [DenseVector(point) for point in block.T]

    begun = time.perf_counter()
    blocks = points if points.columns == ["n", "block"] else pack_points(points, cols)
    fitted = GaussianMixture.train(
        blocks.rdd.flatMap(vectors),
        model.k,
        convergenceTol=tol,
        maxIterations=max_iter,
        seed=seed,
        initialModel=_library_model(model),
    )
    mixture = Mixture(
        fitted.weights,
        [g.mu.toArray() for g in fitted.gaussians],
        [g.sigma.toArray() for g in fitted.gaussians],
    )
    seconds = time.perf_counter() - begun
    closing = log_likelihood(points, mixture, cols) if final_loglik else None
    # the library reports no epochs, so the history is one closing row
    history = [] if closing is None else [Epoch(max_iter, closing, seconds)]
    # with a tolerance the library may stop early, and does not say when
    epochs = max_iter if tol == 0 else None
    return FitResult(
        mixture,
        history,
        None,
        final_loglik=closing,
        trainer="mllib",
        extra={"seconds": seconds, "epochs": epochs},
    )
