"""Component reports and anchor boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mixloom.model import Mixture, as_mixture
from mixloom.operators.scaling import Scales, fix_scales


def component_report(model: DataFrame, scales: Scales) -> DataFrame:
    """Components in original units, numbered by ascending first coordinate.

    ``(rank, component, weight, mean, cov)``; means by ``v * (max - min) + min``
    and covariances by the product of the two ranges. K rows.
    """
    axes = [
        F.struct(F.lit(lo).alias("lo"), F.lit(hi - lo).alias("span"))
        for lo, hi in fix_scales(scales)
    ]
    joined = model.withColumn("_axes", F.array(*axes))
    means = F.zip_with("mean", "_axes", lambda m, a: m * a["span"] + a["lo"])
    covs = F.zip_with(
        "cov",
        "_axes",
        lambda row, a: F.zip_with(row, "_axes", lambda v, b: v * a["span"] * b["span"]),
    )
    restored = joined.select("component", "weight", means.alias("mean"), covs.alias("cov"))
    # an unpartitioned window over the K rows of the model
    rank = F.row_number().over(Window.orderBy(F.get("mean", 0), "component")) - 1
    return restored.select(rank.alias("rank"), "*").orderBy("rank")


def anchor_boxes(model: DataFrame) -> DataFrame:
    """``(component, left, bottom, width, height)``: the mean as a centred box."""
    w, h = F.get("mean", 0), F.get("mean", 1)
    return model.select(
        "component",
        (-w / 2).alias("left"),
        (-h / 2).alias("bottom"),
        w.alias("width"),
        h.alias("height"),
    )


def with_anchor(labelled: DataFrame, model: Mixture | DataFrame) -> DataFrame:
    """Each labelled point with the anchor box of its component.

    Reading the model checks its size, so its boxes can be broadcast.
    """
    boxes = anchor_boxes(as_mixture(model).to_df(labelled.sparkSession))
    return labelled.join(F.broadcast(boxes), "component")
