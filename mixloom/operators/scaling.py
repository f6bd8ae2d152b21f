"""Min-max scaling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixloom.functions.columns import unit_scale, unit_unscale
from mixloom.operators.vectors import is_array, of_length

XY = ("x", "y")
Scales = DataFrame | list[tuple[float, float]]


def compute_scales(points: DataFrame, cols=XY) -> DataFrame:
    """``(dim, min, max)``, one row per axis, from a single aggregation.

    ``cols`` are coordinate columns or one array column.
    """
    if is_array(points, cols):
        long = points.select(
            F.posexplode(F.col(cols[0]).cast("array<double>")).alias("dim", "_v")
        )
        return long.groupBy("dim").agg(F.min("_v").alias("min"), F.max("_v").alias("max"))
    bounds = points.agg(
        *[
            f(F.col(c).cast("double")).alias(f"_{name}{i}")
            for i, c in enumerate(cols)
            for name, f in (("lo", F.min), ("hi", F.max))
        ]
    )
    triples = ", ".join(f"{i}, _lo{i}, _hi{i}" for i in range(len(cols)))
    return bounds.selectExpr(f"stack({len(cols)}, {triples}) AS (dim, min, max)")


def fix_scales(scales: Scales) -> list[tuple[float, float]]:
    """Compute the axis rows once and hold them as plain ``(min, max)`` pairs.

    As many rows as dimensions reach the driver. Later uses then need neither a
    join nor another scan of the points.
    """
    if not isinstance(scales, DataFrame):
        return list(scales)
    rows = sorted(scales.select("dim", "min", "max").collect())
    return [(r["min"], r["max"]) for r in rows]


def _per_axis(points: DataFrame, scales: Scales, cols, change) -> DataFrame:
    bounds = fix_scales(scales)
    if is_array(points, cols):
        lows, highs = (F.array(*[F.lit(v).cast("double") for v in side]) for side in zip(*bounds))
        scaled = F.transform(
            of_length(F.col(cols[0]).cast("array<double>"), len(bounds)),
            lambda v, i: change(v, F.get(lows, i), F.get(highs, i)),
        )
        return points.withColumn(cols[0], scaled)
    if len(bounds) != len(cols):
        raise ValueError(f"{len(bounds)} axes in the scales for {len(cols)} columns")
    return points.withColumns(
        {
            c: change(F.col(c).cast("double"), *[F.lit(v).cast("double") for v in pair])
            for c, pair in zip(cols, bounds)
        }
    )


def minmax_scale(points: DataFrame, scales: Scales, cols=XY) -> DataFrame:
    """Scale each axis to [0, 1]. A constant axis becomes NULL.

    The bounds enter as literals: a projection without join or shuffle.
    """
    return _per_axis(points, scales, cols, unit_scale)


def inverse_scale(points: DataFrame, scales: Scales, cols=XY) -> DataFrame:
    """Bring scaled coordinates back to original units."""
    return _per_axis(points, scales, cols, unit_unscale)


def without_null_axes(points: DataFrame, cols=XY) -> DataFrame:
    """Rows whose coordinates are all present."""
    return points.filter(
        reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])
    )
