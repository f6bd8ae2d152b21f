"""Scale files: one ``min max`` line per axis, in axis order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mixloom.schemas import SCALES
from mixloom.sources.points import tokens


def write_scales(scales: DataFrame, path: str, fmt: str = "text", mode: str = "error"):
    """Write the axis rows (as many as there are dimensions) as one file."""
    ordered = scales.select("dim", "min", "max").coalesce(1).sortWithinPartitions("dim")
    if fmt == "text":
        ordered.select(F.concat_ws(" ", "min", "max").alias("value")).write.mode(
            mode
        ).text(path)
    elif fmt == "parquet":
        ordered.write.mode(mode).parquet(path)
    else:
        raise ValueError("fmt must be 'parquet' or 'text'")


def read_scales(spark: SparkSession, path: str, fmt: str = "text") -> DataFrame:
    """``(dim, min, max)``; in a text file the line number is the axis."""
    if fmt == "parquet":
        return spark.read.schema(SCALES).parquet(path)
    parts = tokens(F.col("value")).cast("array<double>")
    lines = spark.read.text(path).select(
        F.monotonically_increasing_id().alias("_line"), parts.alias("_p")
    )
    # an unpartitioned window, over one row per axis
    return lines.select(
        (F.row_number().over(Window.orderBy("_line")) - 1).alias("dim"),
        F.get("_p", 0).alias("min"),
        F.get("_p", 1).alias("max"),
    )
