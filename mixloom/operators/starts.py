"""Start points and the model they give."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mixloom.functions.columns import seeded_digest
from mixloom.model import MAX_COMPONENTS, Mixture


def sample_starts(
    points: DataFrame,
    k: int,
    seed: int,
    cols=("x", "y"),
    id_col: str = "point_id",
    distinct_starts: bool = False,
) -> DataFrame:
    """K points without replacement: ``component``, the id and the coordinates.

    The order is that of ``md5(id:seed)``, so the draw does not depend on how
    the points are partitioned. Each task keeps its own best K.
    ``distinct_starts`` draws among distinct coordinates, as two components that
    start at the same place never part.
    """
    if not 1 <= k <= MAX_COMPONENTS:
        raise ValueError(f"k must lie in 1..{MAX_COMPONENTS}")
    keyed = points.select(
        seeded_digest(F.col(id_col), seed).alias("_key"), F.col(id_col), *cols
    )
    if distinct_starts:
        keyed = (
            keyed.groupBy(*cols)
            .agg(F.min(F.struct("_key", id_col)).alias("_m"))
            .select("_m._key", f"_m.{id_col}", *cols)
        )
    drawn = keyed.orderBy("_key", id_col).limit(k)
    # numbered after the limit: K rows
    rank = F.row_number().over(Window.orderBy("_key", id_col)) - 1
    return drawn.select(rank.alias("component"), id_col, *cols)


def initial_mixture(starts: DataFrame, k: int, cols=("x", "y")) -> Mixture:
    """Equal weights, the starts as means, identity covariances.

    Raises unless there are exactly K starts, numbered 0 to K - 1.
    """
    rows = sorted(
        starts.select("component", *cols).limit(k + 1).collect(),
        key=lambda r: r.component,
    )
    if len(rows) < k:
        raise ValueError(f"only {len(rows)} points are there for {k} components")
    if [r.component for r in rows] != list(range(k)):
        raise ValueError(f"starts must be numbered 0 to {k - 1}, once each")
    if len(cols) == 1 and isinstance(rows[0][1], (list, tuple)):
        means = [list(r[1]) for r in rows]
    else:
        means = [[float(v) for v in r[1:]] for r in rows]
    return Mixture.at_points(means)


def initial_model(starts: DataFrame, k: int, cols=("x", "y")) -> DataFrame:
    """The same as a model table."""
    return initial_mixture(starts, k, cols).to_df(starts.sparkSession)
