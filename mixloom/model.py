"""The fitted model: K weighted Gaussians, a few kilobytes on the driver."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from mixloom.schemas import MODEL

# A model travels in task closures and literals, so its size is checked.
MAX_COMPONENTS = 10_000
MAX_MODEL_VALUES = 4_000_000


class DegenerateComponent(ValueError):
    """A component lost its points or its covariance became singular.

    ``last_model`` and ``history`` hold the fit as it was before that epoch.
    """

    def __init__(self, message: str, last_model=None, history=None):
        super().__init__(message)
        self.last_model = last_model
        self.history = history or []


@dataclass(frozen=True)
class Mixture:
    """Weights ``(K,)``, means ``(K, d)`` and covariances ``(K, d, d)``."""

    weights: np.ndarray
    means: np.ndarray
    covs: np.ndarray

    def __post_init__(self):
        weights = np.asarray(self.weights, dtype=float)
        means = np.asarray(self.means, dtype=float)
        covs = np.asarray(self.covs, dtype=float)
        k, d = means.shape
        if weights.shape != (k,) or covs.shape != (k, d, d):
            raise ValueError("weights, means and covariances disagree in shape")
        if k > MAX_COMPONENTS or covs.size > MAX_MODEL_VALUES:
            raise ValueError(
                f"model of {k} components in {d} dimensions exceeds the size "
                f"bound ({MAX_COMPONENTS} components, {MAX_MODEL_VALUES} values)"
            )
        object.__setattr__(self, "weights", weights)
        object.__setattr__(self, "means", means)
        object.__setattr__(self, "covs", covs)

    @property
    def k(self) -> int:
        return self.means.shape[0]

    @property
    def d(self) -> int:
        return self.means.shape[1]

    def cholesky(self) -> np.ndarray:
        """Lower factors of all covariances; names the component that has none."""
        factors = np.empty_like(self.covs)
        for i, cov in enumerate(self.covs):
            try:
                factors[i] = np.linalg.cholesky(cov)
            except np.linalg.LinAlgError:
                raise DegenerateComponent(
                    f"covariance of component {i} is singular; use reg_covar > 0 "
                    "or fewer components"
                ) from None
        return factors

    def whitening(self) -> tuple[np.ndarray, np.ndarray]:
        """``(W, c)`` with ``log N_k(x) + log w_k = c_k - |W_k (x - mean_k)|^2 / 2``."""
        factors = self.cholesky()
        inverse = np.stack(
            [np.linalg.solve(f, np.eye(self.d)) for f in factors]
        )
        log_det = np.log(np.diagonal(factors, axis1=1, axis2=2)).sum(axis=1)
        with np.errstate(divide="ignore"):
            log_weight = np.log(self.weights)
        constant = log_weight - log_det - 0.5 * self.d * np.log(2 * np.pi)
        return inverse, constant

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [
            (i, float(self.weights[i]), self.means[i].tolist(), self.covs[i].tolist())
            for i in range(self.k)
        ]
        return spark.createDataFrame(rows, MODEL)

    @classmethod
    def from_df(cls, df: DataFrame) -> "Mixture":
        """Read a model table. At most ``MAX_COMPONENTS + 1`` rows reach the driver."""
        rows = df.select("component", "weight", "mean", "cov").limit(
            MAX_COMPONENTS + 1
        ).collect()
        if not rows:
            raise ValueError("the model table is empty")
        rows.sort(key=lambda r: r.component)
        if [r.component for r in rows] != list(range(len(rows))):
            raise ValueError("component numbers must run from 0 to K-1")
        return cls(
            np.array([r.weight for r in rows]),
            np.array([r.mean for r in rows]),
            np.array([r.cov for r in rows]),
        )

    @classmethod
    def at_points(cls, means) -> "Mixture":
        """Equal weights, given means, identity covariances."""
        means = np.asarray(means, dtype=float)
        k, d = means.shape
        return cls(np.full(k, 1.0 / k), means, np.tile(np.eye(d), (k, 1, 1)))


def as_mixture(model: Mixture | DataFrame) -> Mixture:
    return model if isinstance(model, Mixture) else Mixture.from_df(model)
