"""Coordinates as columns, as an array, and as ML vectors."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_array(df: DataFrame, cols) -> bool:
    """Whether ``cols`` names one array column rather than coordinate columns."""
    return len(cols) == 1 and dict(df.dtypes)[cols[0]].startswith("array")


def to_features(df: DataFrame, cols, out: str = "features") -> DataFrame:
    """Gather columns into one ``array<double>`` column."""
    return df.withColumn(out, F.array(*[F.col(c).cast("double") for c in cols]))


def from_features(df: DataFrame, names, col: str = "features") -> DataFrame:
    """Spread the array into columns; the array column is dropped."""
    return df.withColumns(
        {name: F.get(F.col(col), i) for i, name in enumerate(names)}
    ).drop(col)


def to_vectors(df: DataFrame, col: str = "features", out: str = "vector") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(col).cast("array<double>")))


def from_vectors(df: DataFrame, col: str = "vector", out: str = "features") -> DataFrame:
    return df.withColumn(out, vector_to_array(F.col(col)))


def of_length(array: Column, d: int) -> Column:
    """The array; one of another length than ``d`` raises, NULL stays NULL."""
    message = F.concat(F.lit("an array has "), F.size(array).cast("string"), F.lit(f" components, not {d}"))
    return F.when(array.isNull() | (F.size(array) == d), array).otherwise(F.raise_error(message))
