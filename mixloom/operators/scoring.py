"""Scoring points with a fixed model. Projections only: no shuffle, stream-safe."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mixloom.functions.density import (
    fits_expression,
    log_densities,
    log_densities_arrow,
)
from mixloom.model import Mixture, as_mixture
from mixloom.operators.vectors import is_array, of_length

XY = ("x", "y")
_UNROLL = 64


def _coords(points: DataFrame, cols, d: int) -> list[Column]:
    if is_array(points, cols):
        whole = of_length(F.col(cols[0]), d)
        return [F.get(whole, i).cast("double") for i in range(d)]
    if len(cols) != d:
        raise ValueError(f"{len(cols)} coordinate columns for a model of {d} dimensions")
    return [F.col(c).cast("double") for c in cols]


def with_log_density(
    points: DataFrame, model: Mixture | DataFrame, cols=XY, out: str = "log_density"
) -> DataFrame:
    """Add ``ln(weight_k * N_k(x))`` for every component as an array.

    Small models become plain JVM expressions over the coordinate columns; larger
    ones are scored in Arrow batches. On both ways a point with a NULL or NaN
    coordinate gets NULL, and an array of another length than the model's raises.
    """
    model = as_mixture(model)
    coords = _coords(points, cols, model.d)
    present = reduce(lambda a, b: a & b, [c.isNotNull() & ~F.isnan(c) for c in coords])
    if fits_expression(model):
        density = log_densities(model, coords)
    else:
        nowhere = F.array(*[F.lit(0.0)] * model.d)
        density = log_densities_arrow(model, F.when(present, F.array(*coords)).otherwise(nowhere))
    return points.withColumn(out, F.when(present, density))


def posteriors(
    points: DataFrame, model: Mixture | DataFrame, cols=XY, component: bool = False
) -> DataFrame:
    """Add ``posterior array<double>`` (sums to 1) and ``loglik`` of each point.

    Both are NULL for a point without density. ``component`` adds the most likely
    one before them, from the same densities.
    """
    model = as_mixture(model)
    scored = with_log_density(points, model, cols, "_ld")
    if component:
        scored = scored.withColumn("component", _best("_ld"))
    scored = scored.withColumn("_top", F.array_max("_ld"))
    if model.k <= _UNROLL:
        ks = range(model.k)
        scored = scored.withColumn(
            "_g", F.array(*[F.exp(F.get("_ld", i) - F.col("_top")) for i in ks])
        ).withColumn("_sum", reduce(lambda a, b: a + b, [F.get("_g", i) for i in ks]))
        shares = F.array(*[F.get("_g", i) / F.col("_sum") for i in ks])
    else:
        scored = scored.withColumn(
            "_g", F.transform("_ld", lambda v: F.exp(v - F.col("_top")))
        ).withColumn("_sum", F.aggregate("_g", F.lit(0.0), lambda a, b: a + b))
        shares = F.transform("_g", lambda g: g / F.col("_sum"))
    return scored.withColumns(
        {"posterior": F.when(F.col("_ld").isNotNull(), shares), "loglik": F.col("_top") + F.ln("_sum")}
    ).drop("_ld", "_top", "_g", "_sum")


def posteriors_long(points: DataFrame, model: Mixture | DataFrame, cols=XY) -> DataFrame:
    """One row per point and component: ``component, posterior``."""
    return posteriors(points, model, cols).select(
        *points.columns, F.posexplode("posterior").alias("component", "posterior")
    )


def normalise_long(densities: DataFrame, key: str = "point_id") -> DataFrame:
    """Posteriors from a long table ``(key, component, log_density)`` by window.

    For densities that come from elsewhere; a group has K rows.
    """
    per_point = Window.partitionBy(key)
    shifted = densities.withColumn(
        "_g", F.exp(F.col("log_density") - F.max("log_density").over(per_point))
    )
    return shifted.withColumn(
        "posterior", F.col("_g") / F.sum("_g").over(per_point)
    ).drop("_g")


def assign(points: DataFrame, model: Mixture | DataFrame, cols=XY) -> DataFrame:
    """Add ``component``, the most likely one (lowest number on ties)."""
    scored = with_log_density(points, model, cols, "_ld")
    return scored.withColumn("component", _best("_ld")).drop("_ld")


def _best(densities: str) -> Column:
    return (F.array_position(densities, F.array_max(densities)) - 1).cast("int")


def assign_long(densities: DataFrame, key: str = "point_id") -> DataFrame:
    """``(key, component)`` from a long table ``(key, component, log_density)``.

    The same choice as ``assign`` for densities that come from elsewhere: a maximum
    per point, combined before it is shuffled, in place of a ranking window.
    """
    best = F.max(F.struct("log_density", (-F.col("component")).alias("_c")))
    return (
        densities.groupBy(key)
        .agg(best.alias("_best"))
        .select(key, (-F.col("_best._c")).cast("int").alias("component"))
    )


def component_points(labelled: DataFrame, component: int) -> DataFrame:
    """Points of one component."""
    return labelled.filter(F.col("component") == component)


def component_sizes(model: DataFrame, labels: DataFrame) -> DataFrame:
    """``(component, size)`` with zero for components that own no point."""
    counts = labels.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    return (
        model.select("component").join(counts, "component", "left").na.fill(0, ["size"])
    )


def active_components(model: DataFrame, labels: DataFrame) -> DataFrame:
    """Model rows that own at least one point."""
    owned = labels.select("component").distinct()
    return model.join(owned, "component", "left_semi")


def empty_components(model: DataFrame, labels: DataFrame) -> DataFrame:
    """Model rows that own no point."""
    owned = labels.select("component").distinct()
    return model.join(owned, "component", "left_anti")


def component_coverage(
    points: DataFrame, model: Mixture | DataFrame, q: float = 2.0, cols=XY
) -> DataFrame:
    """Share of each component's points within squared Mahalanobis distance ``q``.

    ``q = 2`` is the ellipse with semi-axes ``sqrt(2 * eigenvalue)``. One scan and
    one aggregation over K groups.
    """
    model = as_mixture(model)
    labelled = with_log_density(points, model, cols, "_ld").withColumn(
        "component", (F.array_position("_ld", F.array_max("_ld")) - 1).cast("int")
    )
    # log-density and squared distance differ by a constant per component
    constants = F.array(*[F.lit(float(c)) for c in model.whitening()[1]])
    own = F.get("_ld", F.col("component"))
    distance = F.lit(2.0) * (F.get(constants, F.col("component")) - own)
    inside = (distance <= F.lit(float(q))).cast("int")
    return (
        labelled.select("component", inside.alias("_in"))
        .groupBy("component")
        .agg(
            F.count(F.lit(1)).alias("size"),
            F.sum("_in").alias("inside"),
            F.avg("_in").alias("coverage"),
        )
    )
