"""Equal-width histograms over the observed or a given range."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixloom.functions.columns import equal_width_bin

Range = tuple[float | None, float | None]


def _ranges(df: DataFrame, cols: list[str], given: list[Range]) -> list[tuple[float, float]]:
    """The range of each axis; two numbers per axis reach the driver.

    A single-valued axis is widened by 1/2 each way, an empty one is [0, 1].
    """
    lows, highs = [g[0] for g in given], [g[1] for g in given]
    if None in lows or None in highs:
        seen = df.agg(
            *[F.min(c).alias(f"lo{i}") for i, c in enumerate(cols)],
            *[F.max(c).alias(f"hi{i}") for i, c in enumerate(cols)],
        ).first()
        lows = [seen[f"lo{i}"] if v is None else v for i, v in enumerate(lows)]
        highs = [seen[f"hi{i}"] if v is None else v for i, v in enumerate(highs)]
    ranges = []
    for lo, hi in zip(lows, highs):
        if lo is None or hi is None:
            lo, hi = 0.0, 1.0
        pad = 0.5 if lo == hi else 0.0
        ranges.append((float(lo) - pad, float(hi) + pad))
    return ranges


def _histogram(
    df: DataFrame, cols: list[str], names: list[str], bins: int, given: list[Range], dense: bool
) -> DataFrame:
    placed = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    for c in cols:
        placed = placed.filter(F.col(c).isNotNull() & ~F.isnan(c))
    ranges = _ranges(placed, cols, given)
    for c, (lo, hi) in zip(cols, ranges):
        placed = placed.filter(F.col(c).between(lo, hi))
    counts = (
        placed.select(
            *[
                equal_width_bin(F.col(c), F.lit(lo), F.lit(hi), bins).alias(name)
                for c, name, (lo, hi) in zip(cols, names, ranges)
            ]
        )
        .groupBy(*names)
        .agg(F.count(F.lit(1)).alias("count"))
    )
    if dense:
        cells = df.sparkSession.range(bins ** len(cols))
        axes = [
            (F.expr(f"(id div {bins ** (len(cols) - 1 - i)}) % {bins}")).alias(name)
            for i, name in enumerate(names)
        ]
        counts = cells.select(*axes).join(counts, names, "left").na.fill(0, ["count"])
    edges = {}
    for name, (lo, hi) in zip(names, ranges):
        suffix = name.removeprefix("bin")
        width = F.lit((hi - lo) / bins)
        edges[f"lo{suffix}"] = F.lit(lo) + width * F.col(name)
        edges[f"hi{suffix}"] = F.lit(lo) + width * (F.col(name) + 1)
    return counts.withColumns(edges).select(*names, *edges, "count")


def hist1d(
    df: DataFrame,
    col: str,
    bins: int = 200,
    lo: float | None = None,
    hi: float | None = None,
    dense: bool = False,
) -> DataFrame:
    """``(bin, lo, hi, count)``; the last bin includes its right edge.

    Values outside a given range, NULL and NaN are left out. ``dense`` adds the empty bins.
    """
    return _histogram(df, [col], ["bin"], bins, [(lo, hi)], dense)


def hist2d(
    df: DataFrame,
    cx: str = "x",
    cy: str = "y",
    bins: int = 100,
    x_range: Range = (None, None),
    y_range: Range = (None, None),
    dense: bool = False,
) -> DataFrame:
    """``(bin_x, bin_y, lo_x, hi_x, lo_y, hi_y, count)``."""
    return _histogram(df, [cx, cy], ["bin_x", "bin_y"], bins, [x_range, y_range], dense)
