"""Point files: one line of space-separated numbers per point."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mixloom.sources.models import read_label_lines
from mixloom.sources.ranges import numbered_lines

_AXES = ("x", "y")


def tokens(line: Column) -> Column:
    """The line's tokens: outer spaces dropped, runs of spaces taken as one."""
    trimmed = F.trim(line)
    # splitting on one plain character needs no regular expression
    return F.when(F.contains(trimmed, F.lit("  ")), F.split(trimmed, " +")).otherwise(
        F.split(trimmed, " ")
    )


def read_points(
    spark: SparkSession,
    path: str,
    n_cols: int | None = None,
    mode: str = "failfast",
):
    """Read a point file with a generated ``point_id``.

    ``n_cols=None`` gives ``features array<double>`` of any length; ``n_cols=2``
    gives ``x`` and ``y`` and any other number ``c0, c1, ...``, with the token
    count checked. ``failfast`` raises on a bad line. ``quarantine`` returns
    ``(points, rejected)``, the second holding ``point_id, line, reason``.

    The ids are unique but tied to this scan: land the points once (see
    ``ingest_points``) before joining anything by them.
    """
    lines = spark.read.text(path).select(
        F.monotonically_increasing_id().alias("point_id"), F.col("value").alias("line")
    )
    return parse_points(lines, n_cols, mode)


def parse_points(lines: DataFrame, n_cols: int | None = None, mode: str = "failfast"):
    """Parse a frame of ``point_id, line``; see ``read_points``."""
    if mode not in ("failfast", "quarantine"):
        raise ValueError("mode must be 'failfast' or 'quarantine'")
    split = lines.withColumn("_tokens", tokens(F.col("line")))
    if n_cols is None:
        names = ["features"]
        wrong_size = F.lit(False)
        parsed = {"features": F.transform("_tokens", lambda t: t.try_cast("double"))}
        no_number = F.exists("features", lambda v: v.isNull())
    else:
        # single columns stay inside generated code, array functions do not
        names = list(_AXES) if n_cols == 2 else [f"c{i}" for i in range(n_cols)]
        wrong_size = F.size("_tokens") != F.lit(n_cols)
        parsed = {n: F.get("_tokens", i).try_cast("double") for i, n in enumerate(names)}
        no_number = reduce(lambda a, b: a | b, [F.col(n).isNull() for n in names])
    judged = split.withColumns(parsed).withColumn(
        "reason",
        F.when(wrong_size, F.lit("column count")).when(no_number, F.lit("not a number")),
    )
    if mode == "failfast":
        complaint = F.concat_ws(": ", F.lit("bad point line"), "reason", "line")
        bad = F.col("reason").isNotNull()
        kinds = dict(judged.dtypes)
        return judged.select(
            "point_id",
            *[
                F.when(bad, F.raise_error(complaint).cast(kinds[n])).otherwise(F.col(n)).alias(n)
                for n in names
            ],
        )
    good = judged.filter(F.col("reason").isNull()).select("point_id", *names)
    rejected = judged.filter(F.col("reason").isNotNull())
    return good, rejected.select("point_id", "line", "reason")


def read_labelled_points(
    spark: SparkSession, points: str, labels: str, n_cols: int | None = None
) -> DataFrame:
    """Points and the labels that stand on the same lines of other files.

    ``point_id`` is the number of the line. The two may be cut into files and byte ranges
    in any way; unequal numbers of lines raise, and so does a bad line.
    """
    lines, n_points = numbered_lines(spark, points)
    components, n_labels = read_label_lines(spark, labels)
    if n_points != n_labels:
        raise ValueError(f"{n_points} points and {n_labels} labels")
    parsed = parse_points(lines.select(F.col("line").alias("point_id"), F.col("value").alias("line")), n_cols)
    return parsed.join(components.withColumnRenamed("line", "point_id"), "point_id")


def ingest_points(
    spark: SparkSession, path: str, landed: str, n_cols: int | None = None
) -> DataFrame:
    """Parse a text file once and land it as Parquet, which fixes the ids."""
    read_points(spark, path, n_cols).write.parquet(landed)
    return spark.read.parquet(landed)


def write_points(
    points: DataFrame, path: str, fmt: str = "parquet", cols=_AXES, mode: str = "error"
) -> None:
    """Write points as Parquet (all columns) or as lines ``"x y"`` (``text``).

    Text output keeps one file per partition; a reader takes the folder.
    """
    if fmt == "parquet":
        points.write.mode(mode).parquet(path)
    elif fmt == "text":
        line = F.concat_ws(" ", *[F.col(c).cast("string") for c in cols])
        points.select(line.alias("value")).write.mode(mode).text(path)
    else:
        raise ValueError("fmt must be 'parquet' or 'text'")
