"""A fixed model applied to a stream of points."""

from __future__ import annotations

from pyspark.sql import DataFrame

from mixloom.model import Mixture, as_mixture
from mixloom.operators.scoring import posteriors


def score_stream(
    stream: DataFrame, model: Mixture | DataFrame, cols=("x", "y")
) -> DataFrame:
    """Add ``posterior``, ``loglik`` and ``component`` to a streaming frame.

    Stateless projections, so the stream keeps its own output mode and watermark.
    """
    return posteriors(stream, as_mixture(model), cols, component=True)
