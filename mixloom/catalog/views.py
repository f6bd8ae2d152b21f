"""Points, boxes and annotations derived from the benchmark tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mixloom.model import Mixture
from mixloom.operators.features import box_features
from mixloom.session import land

SEED = 2014595  # fixed value of the benchmark set-up
SPLITS = ["val", "train"]

# A recorded three-component model of box sides in pixels.
RECORDED_WEIGHTS = [0.378064, 0.239208, 0.382728]
RECORDED_MEANS = [
    [56.5030901136114, 65.1273767851942],
    [199.1742698398557, 192.21783049652925],
    [16.42360617824805, 21.045464723375765],
]
RECORDED_COVS = [
    [[847.4839598367946, 281.0034521252157], [281.0034521252157, 1320.2649658788757]],
    [[15364.620616868875, 5084.102899259593], [5084.102899259593, 11039.208619379386]],
    [[87.81482155694289, 52.28174038200124], [52.28174038200124, 148.83018480171694]],
]


def recorded_model() -> Mixture:
    return Mixture(RECORDED_WEIGHTS, RECORDED_MEANS, RECORDED_COVS)


def recorded_model_with_idle() -> Mixture:
    """The recorded model and a far component that no point is closest to."""
    base = recorded_model()
    return Mixture(
        np.append(base.weights, 1e-6),
        np.vstack([base.means, [[-100000.0, -100000.0]]]),
        np.concatenate([base.covs, np.eye(2)[None]]),
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pts_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order price against days since 1995-01-01."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("point_id"),
        F.col("o_totalprice").alias("x"),
        F.datediff("o_orderdate", F.to_date(F.lit("1995-01-01"))).cast("double").alias("y"),
    )


def pts_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same points brought into the range of the recorded model."""
    return pts_orders(spark, sf_dir).select(
        "point_id", (F.col("x") / 1000.0).alias("x"), ((F.col("y") + 1.0) / 5.0).alias("y")
    )


def pts_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event value against time of day."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("point_id"),
        F.col("value").alias("x"),
        (F.hour("ts") + F.minute("ts") / 60.0).alias("y"),
    )


def pts_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity against price. There is no unique key."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y")
    )


def pts_emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("point_id"),
        F.col("embedding").cast("array<double>").alias("features"),
    )


# the columns that order the boxes of a category within a split
BOX_ORDER = [
    "l_orderkey",
    "l_partkey",
    "l_suppkey",
    "l_linenumber",
    "l_quantity",
    "l_extendedprice",
]


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as boxes: part type as category, line status as split."""
    items = table(spark, sf_dir, "lineitem").select(
        *BOX_ORDER, "l_tax", "l_discount", "l_linestatus"
    )
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    return items.join(parts, "l_partkey").select(
        *BOX_ORDER,
        F.col("p_type").alias("category"),
        F.when(F.col("l_linestatus") == "F", "val").otherwise("train").alias("split"),
        (F.col("l_tax") * 100).alias("w"),
        (F.col("l_discount") * 100).alias("h"),
        F.col("l_quantity").alias("area_segm"),
    )


def kept_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return box_features(boxes(spark, sf_dir))


def box_id() -> Column:
    """The columns that identify a box, as one string."""
    return F.concat_ws(
        "-",
        *[F.col(c).cast("string") for c in BOX_ORDER[:4]],
        F.col("l_quantity").cast("bigint").cast("string"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string"),
    )


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part types, numbered by their lowest part key, and one without parts."""
    types = (
        table(spark, sf_dir, "part")
        .groupBy(F.col("p_type").alias("name"))
        .agg(F.min("p_partkey").alias("id"))
        .select("id", "name")
    )
    unused = spark.range(1).select(F.lit(-1).cast("bigint").alias("id"), F.lit("UNUSED").alias("name"))
    return types.unionByName(unused)


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boxes as flat annotation rows."""
    ids = land(
        categories(spark, sf_dir).select(
            F.col("id").alias("category_id"), F.col("name").alias("category")
        ),
        "categories",
    )
    return boxes(spark, sf_dir).join(ids, "category").select(
        "split",
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"),
        F.col("l_orderkey").alias("image_id"),
        "category_id",
        F.col("area_segm").alias("area"),
        F.array(F.lit(0.0), F.lit(0.0), "w", "h").alias("bbox"),
        (F.col("l_linenumber") % 2).cast("int").alias("iscrowd"),
    )
