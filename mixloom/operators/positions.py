"""Dense positions inside groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mixloom.session import discard, landing_path

_ROW_BITS = 33  # low bits of monotonically_increasing_id() count rows of a partition


def with_positions(
    df: DataFrame, group: str, order: list[str], out: str = "pos", partitions: int | None = None
) -> DataFrame:
    """Number the rows of each group 0, 1, ... in the given order.

    A window over ``group`` would sort a whole group in one task, and one group
    may hold a third of all rows. Here the rows are range-partitioned by group
    and order and each partition's rows are numbered from where the group's rows
    in earlier partitions end. The offsets table has at most one row per
    partition and group boundary.

    The rows are landed with a tie-break first: it spreads copies over several
    partitions, and as it is stored, a task that is run again sees the same one.
    Numbered rows are landed too, so that offsets and rows agree.
    """
    spark = df.sparkSession
    tied_path = landing_path(spark, "tied")
    df.withColumn("_tie", F.monotonically_increasing_id()).write.parquet(tied_path)
    tied = spark.read.parquet(tied_path)
    keys = [group, *order, "_tie"]
    ranged = (
        tied.repartitionByRange(partitions, *keys)
        if partitions
        else tied.repartitionByRange(*keys)
    ).sortWithinPartitions(*keys)
    path = landing_path(spark, "positions")
    ranged.withColumn("_row", F.monotonically_increasing_id()).drop("_tie").write.parquet(path)
    discard(spark, tied_path)
    landed = spark.read.parquet(path).withColumn(
        "_part", F.shiftright("_row", _ROW_BITS)
    )
    runs = landed.groupBy(group, "_part").agg(
        F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    # landed too: Spark then knows its size and broadcasts it only if it is small
    offsets_path = landing_path(spark, "offsets")
    runs.select(
        F.col(group).alias("_group"),
        F.col("_part").alias("_run"),
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
    ).write.parquet(offsets_path)
    offsets = spark.read.parquet(offsets_path)
    same_run = (F.col("_part") == F.col("_run")) & F.col(group).eqNullSafe(F.col("_group"))
    return (
        landed.join(offsets, same_run)
        .withColumn(out, F.col("_row") + F.col("_shift"))
        .drop("_row", "_part", "_group", "_run", "_shift")
    )
