import json
import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mixloom.operators import features as feat
from mixloom.operators.augment import augment
from mixloom.operators.histograms import hist1d, hist2d
from mixloom.operators.positions import with_positions
from mixloom.operators.scaling import (
    compute_scales,
    fix_scales,
    inverse_scale,
    minmax_scale,
    without_null_axes,
)
from mixloom.operators.starts import initial_mixture, sample_starts
from mixloom.operators.vectors import from_features, from_vectors, to_features, to_vectors
from mixloom.sources.annotations import read_annotations, to_documents, write_annotations
from mixloom.sources.history import read_history, to_whole_json, write_history
from mixloom.sources.points import ingest_points, read_points, write_points
from mixloom.sources.scales import read_scales, write_scales

# ---------------------------------------------------------------- points


def put(path, text):
    path.write_text(text)
    return str(path)


def test_points_with_spaces_exponents_and_no_last_newline(spark, tmp_path):
    path = put(tmp_path / "p.txt", "1 2\n  3.5   1.0E-4 \n-1 0.25")
    rows = read_points(spark, path, n_cols=2).orderBy("point_id").collect()
    assert [(r.x, r.y) for r in rows] == [(1.0, 2.0), (3.5, 0.0001), (-1.0, 0.25)]
    assert len({r.point_id for r in rows}) == 3
    free = read_points(spark, path).orderBy("point_id").collect()
    assert free[1].features == [3.5, 0.0001]


@pytest.mark.parametrize("text", ["1 2\n1 x\n", "1 2\n1 2 3\n", "1\n"])
def test_bad_lines_fail_fast(spark, tmp_path, text):
    path = put(tmp_path / "p.txt", text)
    with pytest.raises(Exception, match="bad point line"):
        read_points(spark, path, n_cols=2).collect()


def test_bad_lines_go_to_quarantine(spark, tmp_path):
    path = put(tmp_path / "p.txt", "1 2\n1 x\n1 2 3\n4 5\n")
    good, rejected = read_points(spark, path, n_cols=2, mode="quarantine")
    assert [(r.x, r.y) for r in good.orderBy("point_id").collect()] == [(1.0, 2.0), (4.0, 5.0)]
    assert {(r.line, r.reason) for r in rejected.collect()} == {
        ("1 x", "not a number"),
        ("1 2 3", "column count"),
    }


def test_lines_of_unlike_length_without_a_count(spark, tmp_path):
    path = put(tmp_path / "p.txt", "1 2 3\n4\n")
    rows = read_points(spark, path).orderBy("point_id").collect()
    assert [r.features for r in rows] == [[1.0, 2.0, 3.0], [4.0]]
    three = read_points(spark, put(tmp_path / "q.txt", "1 2 3\n"), n_cols=3)
    assert three.columns == ["point_id", "c0", "c1", "c2"]


def test_landed_points_keep_their_ids(spark, tmp_path):
    path = put(tmp_path / "p.txt", "\n".join(f"{i} {i + 1}" for i in range(50)))
    landed = ingest_points(spark, path, str(tmp_path / "landed"), n_cols=2)
    assert landed.select("point_id").distinct().count() == 50
    assert landed.exceptAll(spark.read.parquet(str(tmp_path / "landed"))).count() == 0


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False), min_size=2, max_size=20))
def test_text_keeps_every_double(spark, tmp_path_factory, values):
    path = str(tmp_path_factory.mktemp("pts") / "t")
    frame = spark.createDataFrame([(v, -v) for v in values], "x double, y double")
    write_points(frame, path, "text")
    back = read_points(spark, path, n_cols=2).collect()
    assert sorted(r.x for r in back) == sorted(values)


def test_parquet_points_and_unknown_format(spark, tmp_path):
    frame = spark.createDataFrame([(1, 1.0, 2.0)], "point_id bigint, x double, y double")
    write_points(frame, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).collect() == frame.collect()
    with pytest.raises(ValueError):
        write_points(frame, str(tmp_path / "q"), "csv")


def test_vectors_roundtrip(spark):
    frame = spark.createDataFrame([(1, 1.0, 2.0, 3.0)], "point_id int, a double, b double, c double")
    gathered = to_features(frame, ["a", "b", "c"])
    back = from_vectors(to_vectors(gathered).drop("features"))
    assert from_features(back, ["a2", "b2", "c2"]).select("a2", "b2", "c2").first() == (1.0, 2.0, 3.0)


# ---------------------------------------------------------------- scaling


@pytest.mark.parametrize("fixed", [True, False])
def test_scaling_and_back(spark, blobs, fixed):
    scales = compute_scales(blobs)
    if fixed:
        scales = fix_scales(scales)
    scaled = minmax_scale(blobs, scales)
    bounds = scaled.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    assert tuple(bounds) == (0.0, 1.0, 0.0, 1.0)
    back = inverse_scale(scaled, scales).select("point_id", F.col("x").alias("x2"), F.col("y").alias("y2"))
    gap = blobs.join(back, "point_id").agg(
        F.max(F.abs(F.col("x") - F.col("x2"))), F.max(F.abs(F.col("y") - F.col("y2")))
    ).first()
    assert max(gap) < 1e-12


def test_constant_axis_becomes_null(spark):
    frame = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0)], "x double, y double")
    for scales in (compute_scales(frame), fix_scales(compute_scales(frame))):
        scaled = minmax_scale(frame, scales)
        assert [r.y for r in scaled.collect()] == [None, None]
        assert without_null_axes(scaled).count() == 0


def test_scales_files(spark, tmp_path):
    text = put(
        tmp_path / "scales.txt",
        "0.19021243185126885 893.2797547639648\n0.11054054730471154 881.1925630823149\n",
    )
    rows = read_scales(spark, text).orderBy("dim").collect()
    assert [tuple(r) for r in rows] == [
        (0, 0.19021243185126885, 893.2797547639648),
        (1, 0.11054054730471154, 881.1925630823149),
    ]
    for fmt in ("text", "parquet"):
        path = str(tmp_path / fmt)
        write_scales(read_scales(spark, text), path, fmt)
        assert sorted(read_scales(spark, path, fmt).collect()) == sorted(rows)


# ---------------------------------------------------------------- starts


def test_starts_do_not_depend_on_layout(blobs):
    base = sample_starts(blobs, 5, 7).collect()
    assert [r.component for r in base] == [0, 1, 2, 3, 4]
    assert len({r.point_id for r in base}) == 5
    assert sample_starts(blobs.repartition(9), 5, 7).collect() == base
    assert sample_starts(blobs, 5, 8).collect() != base


def test_too_few_points_for_k(spark):
    frame = spark.createDataFrame([(1, 0.0, 0.0)], "point_id int, x double, y double")
    assert sample_starts(frame, 3, 1).count() == 1
    with pytest.raises(ValueError, match="only 1"):
        initial_mixture(sample_starts(frame, 3, 1), 3)
    with pytest.raises(ValueError):
        sample_starts(frame, 0, 1)


def test_distinct_starts(spark):
    frame = spark.createDataFrame(
        [(i, float(i % 3), 0.0) for i in range(300)], "point_id int, x double, y double"
    )
    rows = sample_starts(frame, 3, 1, distinct_starts=True).collect()
    assert sorted(r.x for r in rows) == [0.0, 1.0, 2.0]
    mixture = initial_mixture(sample_starts(frame, 3, 1, distinct_starts=True), 3)
    np.testing.assert_allclose(mixture.weights, 1 / 3)
    np.testing.assert_allclose(mixture.covs, np.tile(np.eye(2), (3, 1, 1)))


# ---------------------------------------------------------------- augmentation


def test_copies_stay_within_reach_and_repeat(blobs):
    out = augment(blobs, 3, seed=5)
    assert out.count() == 4 * blobs.count()
    assert out.filter("copy = 0").drop("copy").exceptAll(blobs).count() == 0
    moved = out.join(
        blobs.select("point_id", F.col("x").alias("x0"), F.col("y").alias("y0")), "point_id"
    )
    far = moved.filter(
        (F.abs(F.col("x") - F.col("x0")) > 0.1 * F.abs("x0") + 1e-12)
        | (F.abs(F.col("y") - F.col("y0")) > 0.1 * F.abs("y0") + 1e-12)
    )
    assert far.count() == 0
    assert moved.filter("copy > 0 AND x = x0 AND y = y0").count() == 0
    again = augment(blobs.repartition(8), 3, seed=5).select(out.columns)
    assert again.exceptAll(out).count() == 0
    assert augment(blobs, 3, seed=6).filter("copy > 0").exceptAll(out).count() > 0


def test_no_copies_and_zero_coordinates(spark, blobs):
    assert augment(blobs, 0).drop("copy").exceptAll(blobs).count() == 0
    zero = spark.createDataFrame([(1, 0.0, 0.0)], "point_id int, x double, y double")
    assert {(r.x, r.y) for r in augment(zero, 4).collect()} == {(0.0, 0.0)}
    with pytest.raises(ValueError):
        augment(blobs, -1)


# ---------------------------------------------------------------- histograms


def test_histograms_equal_numpy(blobs, blob_points):
    counts, edges = np.histogram(blob_points[:, 0], bins=17)
    rows = hist1d(blobs, "x", 17, dense=True).orderBy("bin").collect()
    assert [r["count"] for r in rows] == counts.tolist()
    np.testing.assert_allclose([r.lo for r in rows], edges[:-1])
    np.testing.assert_allclose([r.hi for r in rows], edges[1:])
    grid, _, _ = np.histogram2d(blob_points[:, 0], blob_points[:, 1], bins=9)
    dense = hist2d(blobs, bins=9, dense=True).orderBy("bin_x", "bin_y").collect()
    assert [r["count"] for r in dense] == grid.astype(int).ravel().tolist()
    sparse = hist2d(blobs, bins=9)
    assert sparse.count() == int((grid > 0).sum())


def test_histogram_edges_and_given_range(spark):
    frame = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (2.0,), (9.0,), (None,)], "v double")
    rows = hist1d(frame, "v", 2, lo=0.0, hi=2.0).orderBy("bin").collect()
    assert [(r.bin, r["count"]) for r in rows] == [(0, 1), (1, 3)]
    assert hist1d(frame.union(spark.createDataFrame([(float("nan"),)], "v double")), "v", 3).agg(
        F.sum("count")
    ).first()[0] == 5
    single = spark.createDataFrame([(3.0,), (3.0,)], "v double")
    rows = hist1d(single, "v", 4).collect()
    assert [(r.bin, r["count"]) for r in rows] == [(2, 2)]
    empty = hist1d(single.filter("v > 5"), "v", 4, dense=True)
    assert empty.agg(F.sum("count")).first()[0] == 0


# ---------------------------------------------------------------- annotations

DOCUMENTS = {
    "val": {
        "categories": [{"id": 1, "name": "cat"}, {"id": 2, "name": "dog"}, {"id": 9, "name": "yak"}],
        "annotations": [
            {"id": 1, "image_id": 1, "category_id": 1, "area": 6.0, "bbox": [0, 0, 2, 4], "iscrowd": 0},
            {"id": 2, "image_id": 1, "category_id": 1, "area": 5.0, "bbox": [0, 0, 3, 0], "iscrowd": 0},
            {"id": 3, "image_id": 2, "category_id": 2, "area": 4.0, "bbox": [0, 0, 0, 5], "iscrowd": 0},
        ],
    },
    "train": {
        "categories": [{"id": 1, "name": "cat"}, {"id": 2, "name": "dog"}, {"id": 9, "name": "yak"}],
        "annotations": [
            {"id": 4, "image_id": 3, "category_id": 1, "area": 9.0, "bbox": [1, 1, 5, 2], "iscrowd": 1},
            {"id": 5, "image_id": 3, "category_id": 2, "area": 0.5, "bbox": [1, 1, 1, 1], "iscrowd": 0},
            {"id": 6, "image_id": 4, "category_id": 2, "area": 0.0, "bbox": [1, 1, 0, 0], "iscrowd": 0},
        ],
    },
}


@pytest.fixture(scope="module")
def documents(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("docs")
    paths = {}
    for split, content in DOCUMENTS.items():
        path = folder / f"{split}.json"
        path.write_text(json.dumps(content, indent=1))
        paths[split] = str(path)
    return read_annotations(spark, paths, multi_line=True)


def _boxes(documents):
    cats, anns = documents
    return feat.box_features(feat.box_sides(feat.annotations_of(anns, cats)))


def test_annotations_are_read_with_crowd_rows(documents):
    cats, anns = documents
    assert cats.count() == 3 and anns.count() == 6
    assert anns.filter("iscrowd = 1").count() == 1
    picked = feat.select_categories(cats, names=["cat", "dog"], ids=[2, 9])
    assert [r.name for r in picked.collect()] == ["dog"]


def test_joining_categories_shuffles_no_annotations(documents, capsys):
    cats, anns = documents
    feat.annotations_of(anns, cats).explain()
    plan = capsys.readouterr().out
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_documents_roundtrip_in_small_shards(spark, documents, tmp_path):
    cats, anns = documents
    docs = to_documents(cats, anns, per_document=2)
    assert docs.filter("size(annotations) > 2").count() == 0
    write_annotations(docs, str(tmp_path / "d"))
    again = read_annotations(
        spark, {s: str(tmp_path / "d" / f"split={s}") for s in DOCUMENTS}, multi_line=False
    )
    assert again[1].select(anns.columns).exceptAll(anns).count() == 0
    assert again[1].count() == anns.count() and again[0].count() == 3


def test_degenerate_boxes_are_dropped(documents):
    rows = {r.id: r for r in _boxes(documents).collect()}
    assert set(rows) == {1, 4, 5}
    assert (rows[1].ratio, rows[1].inverse_ratio, rows[1].area_box) == (0.5, 2.0, 8.0)


def test_statistics_keep_empty_categories(documents):
    cats, _ = documents
    val = feat.category_stats(cats, _boxes(documents).filter("split = 'val'"))
    got = {r.category: (r.id, r.area_segm, r.area_box, r.ratio, r["count"]) for r in val.collect()}
    assert got == {
        "cat": (1, 6.0, 8.0, 0.5, 1),
        "dog": (2, 0.0, 0.0, 0.0, 0),
        "yak": (9, 0.0, 0.0, 0.0, 0),
    }


def test_means_over_both_splits(documents):
    cats, _ = documents
    kept = _boxes(documents)
    parts = [feat.category_stats(cats, kept.filter(F.col("split") == s)) for s in ("val", "train")]
    merged = {r.category: r for r in feat.merge_stats(*parts).collect()}
    assert merged["cat"].area_box == pytest.approx(9.0)
    assert merged["cat"].ratio == pytest.approx(1.5)
    assert merged["cat"].mean_h == pytest.approx(math.sqrt(9.0 / 1.5))
    assert merged["cat"].mean_w == pytest.approx(math.sqrt(9.0 / 1.5) * 1.5)
    assert merged["yak"].area_box is None and merged["yak"]["count"] == 0
    rolled = {r.category: r for r in feat.class_means(kept).collect()}
    assert rolled["cat"].mean_w == pytest.approx(merged["cat"].mean_w)
    assert rolled[None].is_total == 1 and rolled[None]["count"] == 3
    assert rolled[None].area_box == pytest.approx((8 + 10 + 1) / 3)


def test_sides_from_area_and_aspect(documents):
    history = feat.category_history(
        _boxes(documents), F.when(F.col("split") == "val", 0).otherwise(1), ["id"]
    )
    for r in feat.reconstruct_sides(history).collect():
        assert r.w * r.h == pytest.approx(r.area)
        assert r.h / r.w == pytest.approx(r.hw)


def test_aspects_are_clipped(spark):
    frame = spark.createDataFrame([(60.0, 1.0), (1.0, 2.0)], "w double, h double")
    rows = feat.aspect_clip(frame).orderBy("w").collect()
    assert [(r.aspect_wh, r.aspect_hw) for r in rows] == [(0.5, 2.0), (6.0, 1 / 60)]


# ---------------------------------------------------------------- histories


@pytest.fixture(scope="module")
def uneven(spark):
    """One category with a third of the rows and more, in many copies."""
    rows = [("hot", 0, 7, 1.0, 1.0, 1.0)] * 400
    rows += [("hot", 1, i, float(i + 1), 1.0 / (i + 1), 2.0) for i in range(300)]
    rows += [("mid", i % 2, i, 2.0, 0.5, float(i)) for i in range(101)]
    rows += [("one", 0, 0, 4.0, 0.25, 8.0)]
    return spark.createDataFrame(
        rows, "category string, split_rank int, ann_id int, wh double, hw double, area double"
    ).repartition(5)


ORDER = ["split_rank", "ann_id"]


@pytest.mark.parametrize("partitions", [None, 1, 13])
def test_positions_are_dense_and_ordered(uneven, partitions):
    placed = with_positions(uneven, "category", ORDER, partitions=partitions)
    rows = placed.collect()
    assert len(rows) == 802
    for category, size in (("hot", 700), ("mid", 101), ("one", 1)):
        own = sorted((r for r in rows if r.category == category), key=lambda r: r.pos)
        assert [r.pos for r in own] == list(range(size))
        keys = [(r.split_rank, r.ann_id) for r in own]
        assert keys == sorted(keys)


def test_positions_keep_rows_without_a_group(spark):
    frame = spark.createDataFrame([(None, i) for i in range(5)] + [("a", 1)], "g string, i int")
    rows = with_positions(frame, "g", ["i"]).collect()
    assert sorted(r.pos for r in rows if r.g is None) == [0, 1, 2, 3, 4]
    assert len(rows) == 6


def test_history_files_in_chunks(spark, uneven, tmp_path):
    placed = with_positions(uneven, "category", ORDER).cache()
    path = str(tmp_path / "h")
    write_history(placed, path, chunk_rows=64)
    lines = spark.read.text(f"{path}/name=wh").collect()
    assert max(len(next(iter(json.loads(r.value)["values"].values()))) for r in lines) == 64
    back = read_history(spark, path)
    want = placed.select("category", "pos", "wh", "hw", "area")
    assert back.count() == 802 and back.exceptAll(want).count() == 0


def test_whole_object_history(spark, uneven, tmp_path):
    placed = with_positions(uneven, "category", ORDER).cache()
    paths = {}
    for row in to_whole_json(placed).collect():
        paths[row.name] = put(tmp_path / f"{row.name}.txt", row.value)
        assert set(json.loads(row.value)) == {"hot", "mid", "one"}
    back = read_history(spark, paths, whole=True)
    want = placed.select("category", "pos", "wh", "hw", "area")
    assert back.count() == 802 and back.exceptAll(want).count() == 0


def test_lists_of_unlike_length(spark, tmp_path):
    paths = {
        "wh": put(tmp_path / "wh", '{"a": [1.0, 2.0], "b": [5.0]}'),
        "hw": put(tmp_path / "hw", '{"a": [1.0], "b": [0.2]}'),
        "area": put(tmp_path / "area", '{"a": [3.0, 4.0]}'),
    }
    rows = read_history(spark, paths, whole=True).orderBy("category", "pos").collect()
    assert [tuple(r) for r in rows] == [
        ("a", 0, 1.0, 1.0, 3.0),
        ("a", 1, 2.0, None, 4.0),
        ("b", 0, 5.0, 0.2, None),
    ]


def test_array_axes_are_scaled_as_columns_are(spark, blobs):
    wide = to_features(blobs, ["x", "y"]).select("point_id", "features")
    cols = ("features",)
    scales = compute_scales(wide, cols)
    assert sorted(map(tuple, scales.collect())) == sorted(map(tuple, compute_scales(blobs).collect()))
    scaled = from_features(minmax_scale(wide, scales, cols), ["x", "y"])
    assert scaled.exceptAll(minmax_scale(blobs, compute_scales(blobs))).count() == 0
    with pytest.raises(ValueError, match="axes"):
        minmax_scale(blobs, [(0.0, 1.0)])
