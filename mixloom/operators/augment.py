"""Reproducible jittered copies of points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixloom.functions.columns import digest_uniform, seeded_digest

# Fixed values of the jitter: whole-degree angles, step as a share of the coordinate.
ANGLES = 360
STEP_LOW = 0.0001
STEP_HIGH = 0.1


def augment(
    points: DataFrame,
    extra: int = 16,
    seed: int = 0,
    cols: tuple[str, str] = ("x", "y"),
    id_col: str = "point_id",
) -> DataFrame:
    """The points (``copy = 0``) and ``extra`` jittered copies of each.

    A copy moves ``x`` by ``x * step * cos(angle)`` and ``y`` by
    ``y * step' * sin(angle)``. Angle and steps come from a hash of id, copy and
    seed, so the result does not depend on partitioning or on reruns. One scan,
    no shuffle.
    """
    if extra < 0:
        raise ValueError("extra must not be negative")
    x, y = (F.col(c).cast("double") for c in cols)
    if extra == 0:
        return points.withColumns({cols[0]: x, cols[1]: y, "copy": F.lit(0)})
    copies = points.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(extra))))
    original = F.col("copy") == 0
    # originals are not hashed, and the angle, which both axes take, is a column of its own
    digest = F.when(~original, seeded_digest(F.col(id_col), F.col("copy"), seed))
    hashed = copies.withColumn("_digest", digest)
    degrees = F.floor(digest_uniform(F.col("_digest"), 0) * ANGLES).cast("double")
    hashed = hashed.withColumn("_angle", F.radians(degrees))
    angle = F.col("_angle")
    span = STEP_HIGH - STEP_LOW
    step_x = digest_uniform(F.col("_digest"), 1) * span + STEP_LOW
    step_y = digest_uniform(F.col("_digest"), 2) * span + STEP_LOW
    return hashed.withColumns(
        {
            cols[0]: F.when(original, x).otherwise(x + x * step_x * F.cos(angle)),
            cols[1]: F.when(original, y).otherwise(y + y * step_y * F.sin(angle)),
        }
    ).drop("_digest", "_angle")
