"""From annotations to box features, per-category statistics and histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mixloom.functions.columns import clip, safe_ratio

MEASURES = ("area_segm", "area_box", "ratio")


def select_categories(
    categories: DataFrame, names: list[str] | None = None, ids: list[int] | None = None
) -> DataFrame:
    """Look categories up by name and/or id; no argument keeps all."""
    picked = categories
    if names is not None:
        picked = picked.filter(F.col("name").isin(list(names)))
    if ids is not None:
        picked = picked.filter(F.col("id").isin(list(ids)))
    return picked


def annotations_of(annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """Annotations of the given categories, with the category's name."""
    named = categories.select(F.col("id").alias("category_id"), F.col("name").alias("category"))
    return annotations.join(named, "category_id")


def box_sides(annotations: DataFrame) -> DataFrame:
    """``w``, ``h`` and ``area_segm`` taken from the box and the area."""
    return annotations.withColumns(
        {
            "w": F.get("bbox", 2),
            "h": F.get("bbox", 3),
            "area_segm": F.col("area"),
        }
    )


def box_features(boxes: DataFrame, keep_degenerate: bool = False) -> DataFrame:
    """Add ``area_box``, ``ratio`` (w/h, 0 for h = 0) and ``inverse_ratio`` (h/w).

    Boxes with ratio 0 (no width or no height) are dropped unless asked for;
    their inverse ratio is NULL or 0.
    """
    w, h = F.col("w"), F.col("h")
    featured = boxes.withColumns(
        {
            "area_box": w * h,
            "ratio": safe_ratio(w, h),
            "inverse_ratio": F.try_divide(h, w),
        }
    )
    if keep_degenerate:
        return featured
    # the first two conditions follow from the third and can reach the scan
    return featured.filter("w <> 0 AND h <> 0 AND ratio <> 0")


def _sums() -> list[Column]:
    return [F.sum(m).alias(m) for m in MEASURES] + [F.count(F.lit(1)).alias("count")]


def category_stats(
    categories: DataFrame, boxes: DataFrame, by: str = "category_id"
) -> DataFrame:
    """Sums and count of the kept boxes; a row for every category.

    ``boxes`` come from ``box_features`` and carry the category id in ``by``.
    They are summed before the join, so the join sees one row per category
    however many boxes a category has.
    """
    stats = boxes.groupBy(F.col(by).alias("id")).agg(*_sums())
    zero = {m: 0.0 for m in MEASURES} | {"count": 0}
    return (
        categories.join(stats, "id", "left")
        .na.fill(zero)
        .select(F.col("name").alias("category"), "id", *MEASURES, "count")
    )


def _shape(means: DataFrame) -> DataFrame:
    """Mean height and width of a box with the mean area and mean ratio."""
    height = F.sqrt(F.try_divide(F.col("area_box"), F.col("ratio")))
    return means.withColumn("mean_h", height).withColumn(
        "mean_w", F.col("mean_h") * F.col("ratio")
    )


def _means(sums: DataFrame) -> DataFrame:
    return _shape(
        sums.withColumns({m: F.try_divide(F.col(m), F.col("count")) for m in MEASURES})
    )


def merge_stats(first: DataFrame, second: DataFrame) -> DataFrame:
    """Class means from two splits' statistics, joined on the category.

    Categories come from the first; a category without boxes gets NULL means.
    """
    other = second.select("category", *[F.col(c).alias(f"_{c}") for c in (*MEASURES, "count")])
    joined = first.join(other, "category", "left")
    totals = {
        c: F.coalesce(F.col(c), F.lit(0)) + F.coalesce(F.col(f"_{c}"), F.lit(0))
        for c in (*MEASURES, "count")
    }
    return _means(
        joined.withColumns(totals).select("category", *MEASURES, "count")
    )


def class_means(boxes: DataFrame, category: str = "category") -> DataFrame:
    """Means per category over all splits and, with ``category`` NULL and
    ``is_total = 1``, over everything.

    The rollup runs over the per-category sums, not over the boxes, so that it
    does not double the rows of the scan.
    """
    per_category = boxes.groupBy(category).agg(*_sums())
    sums = per_category.rollup(category).agg(
        *[F.sum(c).alias(c) for c in (*MEASURES, "count")],
        F.grouping(category).cast("int").alias("is_total"),
    )
    return _means(sums).select(
        F.col(category).alias("category"), "is_total", *MEASURES, "count", "mean_h", "mean_w"
    )


def category_history(boxes: DataFrame, split_rank: Column, order: list[str]) -> DataFrame:
    """Long history ``(category, split_rank, <order>, wh, hw, area)`` of kept boxes.

    ``split_rank`` puts one split before the other and ``order`` the boxes inside
    a split; ``with_positions`` turns that into list positions when they are
    needed.
    """
    return boxes.select(
        "category",
        split_rank.alias("split_rank"),
        *order,
        F.col("ratio").alias("wh"),
        F.col("inverse_ratio").alias("hw"),
        F.col("area_segm").alias("area"),
    )


def reconstruct_sides(history: DataFrame) -> DataFrame:
    """Sides with the segmentation's area and the box's aspect: ``w*h = area``."""
    return history.withColumns(
        {
            "h": F.sqrt(F.col("area") * F.col("hw")),
            "w": F.sqrt(F.try_divide(F.col("area"), F.col("hw"))),
        }
    )


def aspect_clip(boxes: DataFrame, low: float = 0.0, high: float = 6.0) -> DataFrame:
    """Both aspect ratios of ``w`` and ``h``, held inside [low, high]."""
    w, h = F.col("w"), F.col("h")
    return boxes.withColumns(
        {
            "aspect_wh": clip(F.try_divide(w, h), low, high),
            "aspect_hw": clip(F.try_divide(h, w), low, high),
        }
    )
