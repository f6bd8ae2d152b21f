"""Log-densities of a fixed mixture as columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from mixloom.model import Mixture

# Beyond these the expression would outgrow generated code; Arrow takes over.
MAX_EXPRESSION_DIMS = 8
MAX_EXPRESSION_TERMS = 512


def fits_expression(model: Mixture) -> bool:
    terms = model.k * model.d * (model.d + 1) // 2
    return model.d <= MAX_EXPRESSION_DIMS and terms <= MAX_EXPRESSION_TERMS


def squared_distances(model: Mixture, coords: list[Column]) -> list[Column]:
    """Squared Mahalanobis distance to each component, written out in full."""
    whiten, _ = model.whitening()
    distances = []
    for w, mean in zip(whiten, model.means):
        offsets = [c - F.lit(float(m)) for c, m in zip(coords, mean)]
        total = None
        for i in range(model.d):
            z = sum(
                (F.lit(float(w[i, j])) * offsets[j] for j in range(1, i + 1)),
                F.lit(float(w[i, 0])) * offsets[0],
            )
            total = z * z if total is None else total + z * z
        distances.append(total)
    return distances


def log_densities(model: Mixture, coords: list[Column]) -> Column:
    """``array<double>`` of ``ln(weight_k * N_k(x))`` as JVM expressions."""
    _, constant = model.whitening()
    distances = squared_distances(model, coords)
    return F.array(
        *[F.lit(float(c)) - F.lit(0.5) * q for c, q in zip(constant, distances)]
    )


def log_densities_arrow(model: Mixture, features: Column) -> Column:
    """The same from one array column, for models too large to write out."""
    whiten, constant = model.whitening()
    k, d = model.means.shape
    flat = whiten.reshape(k * d, d)
    middle = model.means.mean(axis=0)
    shift = np.einsum("kij,kj->ki", whiten, model.means - middle).reshape(k * d, 1)

    def score(batch: pa.Array) -> pa.Array:
        n = len(batch)
        if batch.null_count:
            raise ValueError("feature arrays must be present")
        points = batch.flatten().to_numpy(zero_copy_only=False).reshape(n, d)
        out = np.empty((n, k))
        step = max(64, (1 << 18) // (k * d))
        for lo in range(0, n, step):
            part = points[lo : lo + step] - middle
            z = (flat @ part.T - shift).reshape(k, d, -1)
            out[lo : lo + step] = (constant[:, None] - 0.5 * (z * z).sum(axis=1)).T
        offsets = np.arange(0, (n + 1) * k, k, dtype="int32")
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(out.ravel()))

    return F.arrow_udf(score, "array<double>")(features)
