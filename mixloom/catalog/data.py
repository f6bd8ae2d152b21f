"""Sources, sinks, projections, box statistics and histograms."""

from __future__ import annotations

from pyspark.sql import functions as F

from mixloom.catalog import oracle as O
from mixloom.catalog import views as V
from mixloom.catalog.registry import query, rounded
from mixloom.operators import features as feat
from mixloom.operators.augment import augment
from mixloom.operators.histograms import hist1d, hist2d
from mixloom.operators.positions import with_positions
from mixloom.operators.scaling import compute_scales, inverse_scale, minmax_scale
from mixloom.operators.vectors import from_vectors, to_features, to_vectors
from mixloom.session import landing_path
from mixloom.sources.annotations import (
    explode_documents,
    read_annotations,
    read_large_annotations,
    to_documents,
    write_annotations,
    write_large_annotations,
)
from mixloom.sources.history import read_history, read_whole_history, write_history, write_whole_history
from mixloom.sources.points import parse_points, read_points, write_points
from mixloom.sources.scales import read_scales, write_scales

# ---------------------------------------------------------------- points and scales


@query(
    "s01_points_text_roundtrip",
    f"SELECT round(x, 6) AS x, round(y, 6) AS y FROM ({O.PTS_ORDERS})",
)
def points_text(spark, sf_dir):
    path = landing_path(spark, "points")
    write_points(V.pts_orders(spark, sf_dir), path, "text")
    return read_points(spark, path, n_cols=2).select(rounded("x"), rounded("y"))


@query(
    "s01_points_text_any_d",
    """SELECT vec_id, CAST(pos - 1 AS INT) AS pos, round(CAST(embedding[pos] AS DOUBLE), 6) AS value
FROM embeddings, (SELECT unnest(range(1, 65)) AS pos)""",
)
def points_text_any_d(spark, sf_dir):
    """65 numbers a line: the id and all 64 coordinates."""
    path = landing_path(spark, "points")
    emb = V.pts_emb(spark, sf_dir)
    line = F.concat_ws(" ", "point_id", F.array_join("features", " "))
    emb.select(line.alias("value")).write.text(path)
    parsed = read_points(spark, path)
    return parsed.select(
        F.get("features", 0).cast("bigint").alias("vec_id"),
        F.posexplode(F.slice("features", 2, F.size("features") - 1)).alias("pos", "_v"),
    ).select("vec_id", "pos", rounded("_v", alias="value"))


@query(
    "s02_two_column_quarantine",
    """SELECT event_id AS point_id,
  CASE WHEN event_type NOT IN ('error', 'click') THEN round(value, 6) END AS x,
  CASE WHEN event_type NOT IN ('error', 'click') THEN CAST(hour(ts) AS DOUBLE) END AS y,
  CASE event_type WHEN 'click' THEN 'column count' WHEN 'error' THEN 'not a number' END AS reason
FROM events""",
)
def two_column_quarantine(spark, sf_dir):
    """Lines made from events: errors lack a number, clicks have a third token."""
    kind = F.col("event_type")
    second = F.when(kind == "error", F.col("event_type")).otherwise(
        F.hour("ts").cast("string")
    )
    third = F.when(kind == "click", F.col("user_id").cast("string"))
    lines = V.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("point_id"),
        F.concat(
            F.lit(" "), F.concat_ws("  ", F.col("value").cast("string"), second, third), F.lit(" ")
        ).alias("line"),
    )
    good, rejected = parse_points(lines, n_cols=2, mode="quarantine")
    return good.select(
        "point_id", rounded("x"), "y", F.lit(None).cast("string").alias("reason")
    ).unionByName(
        rejected.select(
            "point_id",
            F.lit(None).cast("double").alias("x"),
            F.lit(None).cast("double").alias("y"),
            "reason",
        )
    )


@query(
    "s03_scales_roundtrip",
    f"""SELECT CAST(0 AS INT) AS dim, min(x) AS min, max(x) AS max FROM ({O.PTS_ORDERS})
UNION ALL SELECT 1, min(y), max(y) FROM ({O.PTS_ORDERS})""",
)
def scales_text(spark, sf_dir):
    path = landing_path(spark, "scales")
    write_scales(compute_scales(V.pts_orders(spark, sf_dir)), path)
    return read_scales(spark, path)


@query(
    "a01_axis_bounds",
    """SELECT CAST(0 AS INT) AS dim, min(l_quantity) AS min, max(l_quantity) AS max FROM lineitem
UNION ALL SELECT 1, min(l_extendedprice), max(l_extendedprice) FROM lineitem""",
)
def axis_bounds(spark, sf_dir):
    return compute_scales(V.pts_lineitem(spark, sf_dir))


_WIDE = """(SELECT vec_id, CAST(pos - 1 AS INT) AS dim, CAST(embedding[pos] AS DOUBLE) AS v
FROM embeddings, (SELECT unnest(range(1, 65)) AS pos))"""


@query(
    "a01_axis_bounds_64d",
    f"SELECT dim, round(min(v), 6) AS min, round(max(v), 6) AS max FROM {_WIDE} GROUP BY dim",
)
def axis_bounds_wide(spark, sf_dir):
    return compute_scales(V.pts_emb(spark, sf_dir), ("features",)).select(
        "dim", rounded("min"), rounded("max")
    )


@query(
    "p04_minmax_scale_64d",
    f"""SELECT vec_id, dim, round((v - lo) / (hi - lo), 6) AS value FROM {_WIDE}
JOIN (SELECT dim, min(v) AS lo, max(v) AS hi FROM {_WIDE} GROUP BY dim) USING (dim)""",
)
def minmax_wide(spark, sf_dir):
    points = V.pts_emb(spark, sf_dir)
    cols = ("features",)
    scaled = minmax_scale(points, compute_scales(points, cols), cols)
    return scaled.select(
        F.col("point_id").alias("vec_id"), F.posexplode("features").alias("dim", "_v")
    ).select("vec_id", "dim", rounded("_v", alias="value"))


@query(
    "a02_point_count",
    "SELECT count(*) AS n_points, count(DISTINCT x) AS distinct_x FROM "
    "(SELECT l_quantity AS x FROM lineitem)",
)
def point_count(spark, sf_dir):
    return V.pts_lineitem(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("n_points"), F.countDistinct("x").alias("distinct_x")
    )


@query(
    "p04_minmax_scale",
    f"SELECT id AS point_id, round(x, 6) AS x, round(y, 6) AS y FROM ({O.scaled(O.PTS_ORDERS)})",
)
def minmax(spark, sf_dir):
    points = V.pts_orders(spark, sf_dir)
    return minmax_scale(points, compute_scales(points)).select(
        "point_id", rounded("x"), rounded("y")
    )


@query(
    "p04_minmax_constant_axis",
    "SELECT p_partkey AS point_id, round((p_retailprice - lo) / (hi - lo), 6) AS x, "
    "CAST(NULL AS DOUBLE) AS y FROM part, (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part)",
)
def minmax_constant(spark, sf_dir):
    points = V.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("point_id"), F.col("p_retailprice").alias("x"), F.lit(7.0).alias("y")
    )
    return minmax_scale(points, compute_scales(points)).select("point_id", rounded("x"), rounded("y"))


@query(
    "p05_inverse_scale",
    f"SELECT id AS point_id, round(x, 4) AS x, round(y, 4) AS y FROM ({O.PTS_ORDERS})",
)
def inverse(spark, sf_dir):
    points = V.pts_orders(spark, sf_dir)
    scales = compute_scales(points)
    return inverse_scale(minmax_scale(points, scales), scales).select(
        "point_id", rounded("x", 4), rounded("y", 4)
    )


@query(
    "p08_vector_roundtrip",
    """SELECT vec_id, CAST(pos - 1 AS INT) AS pos, round(CAST(embedding[pos] AS DOUBLE), 6) AS value
FROM embeddings, (SELECT unnest(range(1, 65)) AS pos)""",
)
def vectors(spark, sf_dir):
    back = from_vectors(to_vectors(V.pts_emb(spark, sf_dir)).drop("features"))
    return back.select(
        F.col("point_id").alias("vec_id"), F.posexplode("features").alias("pos", "_v")
    ).select("vec_id", "pos", rounded("_v", alias="value"))


@query(
    "p08_columns_to_features",
    f"SELECT id AS point_id, round(x, 6) AS f0, round(y, 6) AS f1 FROM ({O.PTS_EVENTS})",
)
def columns_to_features(spark, sf_dir):
    gathered = to_features(V.pts_events(spark, sf_dir), ["x", "y"])
    return gathered.select(
        "point_id",
        F.round(F.get("features", 0), 6).alias("f0"),
        F.round(F.get("features", 1), 6).alias("f1"),
    )


# ---------------------------------------------------------------- augmentation


def _augmented_sql(extra: int) -> str:
    return (
        "SELECT id AS point_id, copy, round(x, 6) AS x, round(y, 6) AS y "
        f"FROM ({O.augmented(O.PTS_PIXELS, extra, V.SEED)})"
    )


@query("p09_augment", _augmented_sql(2))
def augmented(spark, sf_dir):
    return augment(V.pts_pixels(spark, sf_dir), 2, V.SEED).select(
        "point_id", "copy", rounded("x"), rounded("y")
    )


@query("s09_augmented_roundtrip", _augmented_sql(1))
def augmented_saved(spark, sf_dir):
    path = landing_path(spark, "augmented")
    write_points(augment(V.pts_pixels(spark, sf_dir), 1, V.SEED), path)
    return spark.read.parquet(path).select("point_id", "copy", rounded("x"), rounded("y"))


@query(
    "u02_augment_count",
    f"SELECT copy, count(*) AS n FROM ({O.augmented(O.PTS_EVENTS, 16, V.SEED)}) GROUP BY copy",
)
def augment_count(spark, sf_dir):
    return (
        augment(V.pts_events(spark, sf_dir), 16, V.SEED)
        .groupBy("copy")
        .agg(F.count(F.lit(1)).alias("n"))
    )


# ---------------------------------------------------------------- annotations


_NESTED = """SELECT CASE WHEN l_linestatus = 'F' THEN 'val' ELSE 'train' END AS split,
  l_orderkey * 8 + l_linenumber AS id, l_orderkey AS image_id, p_type AS category, l_quantity AS area,
  round(l_tax * 100, 6) AS w, round(l_discount * 100, 6) AS h, CAST(l_linenumber % 2 AS INT) AS iscrowd
FROM lineitem JOIN part ON l_partkey = p_partkey"""


@query("s06_annotations_nested", _NESTED)
def annotations_nested(spark, sf_dir):
    path = landing_path(spark, "annotations")
    documents = to_documents(
        V.categories(spark, sf_dir), V.annotations(spark, sf_dir), splits=V.SPLITS
    )
    write_annotations(documents, path)
    paths = {s: f"{path}/split={s}" for s in V.SPLITS}
    cats, anns = read_annotations(spark, paths, multi_line=False)
    return feat.box_sides(feat.annotations_of(anns, cats)).select(
        "split", "id", "image_id", "category", "area", rounded("w"), rounded("h"), "iscrowd"
    )


@query("s06_annotations_one_document", _NESTED)
def annotations_one_document(spark, sf_dir):
    """Each split one JSON document, written in parts and read by byte ranges."""
    path = landing_path(spark, "documents")
    categories, rows = V.categories(spark, sf_dir), V.annotations(spark, sf_dir)
    paths = {s: f"{path}/split={s}" for s in V.SPLITS}
    for split, folder in paths.items():
        write_large_annotations(categories, rows.where(F.col("split") == split), folder)
    cats, anns = read_large_annotations(spark, paths, joined=True)
    return feat.box_sides(feat.annotations_of(anns, cats)).select(
        "split", "id", "image_id", "category", "area", rounded("w"), rounded("h"), "iscrowd"
    )


@query(
    "s06_category_list",
    f"SELECT id, name FROM ({O.CATEGORIES})",
)
def category_list(spark, sf_dir):
    """Categories found again in both splits' documents, once each."""
    documents = to_documents(
        V.categories(spark, sf_dir), V.annotations(spark, sf_dir), splits=V.SPLITS
    )
    return explode_documents(documents)[0]


@query(
    "p10_category_selection",
    f"""SELECT b.split, c.id AS category_id, c.name AS category, count(*) AS n, sum(area_segm) AS area
FROM ({O.BOXES}) b JOIN ({O.CATEGORIES}) c ON b.category = c.name
WHERE c.name IN ('SMALL', 'PROMO', 'UNUSED') GROUP BY ALL""",
)
def category_selection(spark, sf_dir):
    chosen = feat.select_categories(
        V.categories(spark, sf_dir), names=["SMALL", "PROMO", "UNUSED"]
    )
    found = feat.annotations_of(V.annotations(spark, sf_dir), chosen)
    return found.groupBy("split", "category_id", "category").agg(
        F.count(F.lit(1)).alias("n"), F.sum("area").alias("area")
    )


@query(
    "p01_box_features",
    f"""SELECT {O.BOX_ORDER}, category, split, round(area_box, 6) AS area_box,
  round(ratio, 6) AS ratio, round(inverse_ratio, 6) AS inverse_ratio FROM ({O.KEPT})""",
)
def box_features(spark, sf_dir):
    return V.kept_boxes(spark, sf_dir).select(
        *V.BOX_ORDER,
        "category",
        "split",
        rounded("area_box"),
        rounded("ratio"),
        rounded("inverse_ratio"),
    )


@query(
    "p02_degenerate_boxes",
    f"""SELECT split, w = 0 AS no_width, h = 0 AS no_height, count(*) AS n,
  round(sum(CASE WHEN h = 0 THEN 0 ELSE w / h END), 4) AS ratio FROM ({O.BOXES}) GROUP BY ALL""",
)
def degenerate_boxes(spark, sf_dir):
    """What the filter drops and keeps, by kind."""
    every = feat.box_features(V.boxes(spark, sf_dir), keep_degenerate=True)
    return every.groupBy(
        "split", (F.col("w") == 0).alias("no_width"), (F.col("h") == 0).alias("no_height")
    ).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("ratio"), 4).alias("ratio"))


_STATS = """round(coalesce(sum(area_segm), 0), 4) AS area_segm, round(coalesce(sum(area_box), 0), 4) AS area_box,
  round(coalesce(sum(ratio), 0), 4) AS ratio, count(ratio) AS count"""


def _stat_columns():
    return [rounded("area_segm", 4), rounded("area_box", 4), rounded("ratio", 4), "count"]


def _stats(spark, sf_dir, split=None):
    """Statistics by category id; the annotations carry ids, not names."""
    cats = V.categories(spark, sf_dir)
    kept = feat.box_features(feat.box_sides(V.annotations(spark, sf_dir)))
    if split is not None:
        kept = kept.filter(F.col("split") == split)
    return feat.category_stats(cats, kept)


@query(
    "j01_category_left_join",
    f"""SELECT c.name AS category, c.id AS id, {_STATS} FROM ({O.CATEGORIES}) c
LEFT JOIN (SELECT * FROM ({O.KEPT}) WHERE split = 'val') b ON b.category = c.name GROUP BY c.name, c.id""",
)
def category_left_join(spark, sf_dir):
    return _stats(spark, sf_dir, "val").select("category", "id", *_stat_columns())


@query(
    "a03_category_stats",
    f"""SELECT c.name AS category, c.id AS id, {_STATS} FROM ({O.CATEGORIES}) c
LEFT JOIN ({O.KEPT}) b ON b.category = c.name GROUP BY c.name, c.id""",
)
def category_stats(spark, sf_dir):
    return _stats(spark, sf_dir).select("category", "id", *_stat_columns())


_MEANS = """round(avg(area_segm), 6) AS area_segm, round(avg(area_box), 6) AS area_box, round(avg(ratio), 6) AS ratio,
  count(ratio) AS count, round(sqrt(avg(area_box) / avg(ratio)), 6) AS mean_h,
  round(sqrt(avg(area_box) / avg(ratio)) * avg(ratio), 6) AS mean_w"""


def _mean_columns():
    return [
        rounded("area_segm"),
        rounded("area_box"),
        rounded("ratio"),
        "count",
        rounded("mean_h"),
        rounded("mean_w"),
    ]


@query(
    "j02_split_merge",
    f"""SELECT c.name AS category, {_MEANS} FROM ({O.CATEGORIES}) c
LEFT JOIN ({O.KEPT}) b ON b.category = c.name GROUP BY c.name""",
)
def split_merge(spark, sf_dir):
    merged = feat.merge_stats(_stats(spark, sf_dir, "val"), _stats(spark, sf_dir, "train"))
    return merged.select("category", *_mean_columns())


@query(
    "a05_class_means",
    f"SELECT category, {_MEANS} FROM ({O.KEPT}) GROUP BY category",
)
def class_means(spark, sf_dir):
    means = feat.class_means(V.kept_boxes(spark, sf_dir)).filter("is_total = 0")
    return means.select("category", *_mean_columns())


@query(
    "a06_rollup_means",
    f"SELECT category, CAST(grouping(category) AS INT) AS is_total, {_MEANS} FROM ({O.KEPT}) GROUP BY ROLLUP (category)",
)
def rollup_means(spark, sf_dir):
    means = feat.class_means(V.kept_boxes(spark, sf_dir))
    return means.select("category", "is_total", *_mean_columns())


# ---------------------------------------------------------------- histories


def _history(spark, sf_dir):
    rank = F.when(F.col("split") == "val", 0).otherwise(1)
    return feat.category_history(V.kept_boxes(spark, sf_dir), rank, V.BOX_ORDER)


_HISTORY = f"""SELECT category, CASE split WHEN 'val' THEN 0 ELSE 1 END AS split_rank,
  row_number() OVER (PARTITION BY category ORDER BY CASE split WHEN 'val' THEN 0 ELSE 1 END, {O.BOX_ORDER}) - 1 AS pos,
  ratio AS wh, inverse_ratio AS hw, area_segm AS area FROM ({O.KEPT})"""


@query(
    "u01_history_union",
    f"SELECT category, CAST(split_rank AS INT) AS split_rank, count(*) AS n, min(pos) AS first_pos, "
    f"max(pos) AS last_pos, round(sum(wh), 4) AS wh FROM ({_HISTORY}) GROUP BY category, split_rank",
)
def history_union(spark, sf_dir):
    """One split appended to the other: its positions come first."""
    parts = [_history(spark, sf_dir).filter(F.col("split_rank") == r) for r in (0, 1)]
    appended = parts[0].unionByName(parts[1])
    placed = with_positions(appended, "category", ["split_rank", *V.BOX_ORDER])
    return placed.groupBy("category", "split_rank").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("pos").alias("first_pos"),
        F.max("pos").alias("last_pos"),
        F.round(F.sum("wh"), 4).alias("wh"),
    )


_HISTORY_OUT = f"SELECT category, pos, round(wh, 6) AS wh, round(hw, 6) AS hw, area FROM ({_HISTORY})"


@query("a04_category_lists", _HISTORY_OUT)
def category_lists(spark, sf_dir):
    placed = with_positions(
        _history(spark, sf_dir), "category", ["split_rank", *V.BOX_ORDER]
    )
    return placed.select("category", "pos", rounded("wh"), rounded("hw"), "area")


@query("s07_history_json_roundtrip", _HISTORY_OUT)
def history_json(spark, sf_dir):
    path = landing_path(spark, "history")
    write_history(
        with_positions(_history(spark, sf_dir), "category", ["split_rank", *V.BOX_ORDER]), path
    )
    return read_history(spark, path).select(
        "category", "pos", rounded("wh"), rounded("hw"), "area"
    )


@query("s07_history_one_object", _HISTORY_OUT)
def history_one_object(spark, sf_dir):
    """Three objects of whole lists, written in parts and read by byte ranges."""
    path = landing_path(spark, "history")
    placed = with_positions(_history(spark, sf_dir), "category", ["split_rank", *V.BOX_ORDER])
    write_whole_history(placed, path)
    return read_whole_history(spark, path).select("category", "pos", rounded("wh"), rounded("hw"), "area")


@query(
    "p03_reconstruct_sides",
    f"""SELECT {O.BOX_ORDER}, category, round(sqrt(area_segm / inverse_ratio), 6) AS w,
  round(sqrt(area_segm * inverse_ratio), 6) AS h FROM ({O.KEPT})""",
)
def reconstruct(spark, sf_dir):
    return feat.reconstruct_sides(_history(spark, sf_dir)).select(
        *V.BOX_ORDER, "category", rounded("w"), rounded("h")
    )


# ---------------------------------------------------------------- histograms

_SIDES = f"SELECT sqrt(area_segm / inverse_ratio) AS w, sqrt(area_segm * inverse_ratio) AS h FROM ({O.KEPT})"


def _sides(spark, sf_dir):
    return feat.reconstruct_sides(_history(spark, sf_dir)).select("w", "h")


@query(
    "p06_aspect_clip",
    f"""SELECT {O.BOX_ORDER}, category, round(least(6.0, greatest(0.0, w / h)), 6) AS aspect_wh,
  round(least(6.0, greatest(0.0, h / w)), 6) AS aspect_hw FROM ({O.KEPT})""",
)
def aspect_clip(spark, sf_dir):
    return feat.aspect_clip(V.kept_boxes(spark, sf_dir)).select(
        *V.BOX_ORDER, "category", rounded("aspect_wh"), rounded("aspect_hw")
    )


def _hist1d_sql(value: str, source: str, bins: int) -> str:
    return f"""WITH v AS (SELECT {value} AS v FROM ({source})),
b AS (SELECT min(v) AS lo, max(v) AS hi FROM v),
n AS (SELECT CAST(least(floor((v - lo) / (hi - lo) * {bins}.0), {bins - 1}) AS BIGINT) AS bin, count(*) AS c FROM v, b GROUP BY 1)
SELECT i AS bin, round(lo + (hi - lo) / {bins} * i, 6) AS lo, round(lo + (hi - lo) / {bins} * (i + 1), 6) AS hi,
  coalesce(c, 0) AS count FROM b, (SELECT unnest(range({bins})) AS i) LEFT JOIN n ON n.bin = i"""


@query(
    "a11_hist1d",
    _hist1d_sql("least(6.0::DOUBLE, greatest(0.0::DOUBLE, w / h))", O.KEPT, 200),
)
def aspect_histogram(spark, sf_dir):
    clipped = feat.aspect_clip(V.kept_boxes(spark, sf_dir))
    return hist1d(clipped, "aspect_wh", 200, dense=True).select(
        "bin", rounded("lo"), rounded("hi"), "count"
    )


@query(
    "a11_hist1d_inverse",
    _hist1d_sql("least(6.0::DOUBLE, greatest(0.0::DOUBLE, h / w))", O.KEPT, 200),
)
def inverse_aspect_histogram(spark, sf_dir):
    clipped = feat.aspect_clip(V.kept_boxes(spark, sf_dir))
    return hist1d(clipped, "aspect_hw", 200, dense=True).select(
        "bin", rounded("lo"), rounded("hi"), "count"
    )


def _hist2d_sql(source: str, x: str, y: str, bins: int) -> str:
    return f"""WITH v AS MATERIALIZED ({source}),
b AS (SELECT min({x}) AS x0, max({x}) AS x1, min({y}) AS y0, max({y}) AS y1 FROM v)
SELECT CAST(least(floor(({x} - x0) / (x1 - x0) * {bins}.0), {bins - 1}) AS BIGINT) AS bin_x,
  CAST(least(floor(({y} - y0) / (y1 - y0) * {bins}.0), {bins - 1}) AS BIGINT) AS bin_y, count(*) AS count
FROM v, b GROUP BY 1, 2"""


@query("a12_hist2d", _hist2d_sql(_SIDES, "w", "h", 100))
def sides_histogram(spark, sf_dir):
    return hist2d(_sides(spark, sf_dir), "w", "h", 100).select("bin_x", "bin_y", "count")


@query(
    "a12_hist2d_augmented",
    _hist2d_sql(O.augmented(O.PTS_PIXELS, 2, V.SEED), "x", "y", 100),
)
def augmented_histogram(spark, sf_dir):
    return hist2d(augment(V.pts_pixels(spark, sf_dir), 2, V.SEED), bins=100).select(
        "bin_x", "bin_y", "count"
    )
