"""Reusable column expressions; all of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """``numerator / denominator``, 0 where the denominator is 0."""
    return F.coalesce(F.try_divide(numerator, denominator), F.lit(0.0))


def clip(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value))


def unit_scale(value: Column, low: Column, high: Column) -> Column:
    """Min-max scaling; NULL on a constant axis."""
    return F.try_divide(value - low, high - low)


def unit_unscale(value: Column, low: Column, high: Column) -> Column:
    return value * (high - low) + low


def seeded_digest(*parts: Column | int) -> Column:
    """32 hex digits that depend on the parts only, never on the partitioning."""
    texts = [
        (p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts
    ]
    return F.md5(F.concat_ws(":", *texts))


def digest_word(digest: Column, word: int) -> Column:
    """The ``word``-th group of 8 hex digits as a bigint in [0, 2^32)."""
    return F.conv(F.substring(digest, 8 * word + 1, 8), 16, 10).cast("bigint")


def digest_uniform(digest: Column, word: int) -> Column:
    """The same group as a double in [0, 1)."""
    return digest_word(digest, word) / F.lit(4294967296.0)


def equal_width_bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    """0-based bin of equal width over [low, high]; the last bin is closed."""
    position = F.floor((value - low) / (high - low) * F.lit(float(bins)))
    return F.least(position, F.lit(bins - 1).cast("bigint"))
