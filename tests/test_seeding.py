"""Start centres drawn over packed points, and the best of several k-means fits."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from mixloom.catalog import fits
from mixloom.functions import kernels
from mixloom.plans import kmeans as KM
from mixloom.plans import seeding
from mixloom.plans.blocks import NoPoints, packed, pack_points


def plain_cost(points, centres):
    return ((points[:, None] - centres) ** 2).sum(axis=2).min(axis=1).sum()


def batch_of(points):
    import pyarrow as pa

    block = np.ascontiguousarray(np.asarray(points, float).T).tobytes()
    return pa.RecordBatch.from_arrays(
        [pa.array([len(points)], pa.int32()), pa.array([block], pa.binary())], names=["n", "block"]
    )


def winners(blocks, draw):
    out = []
    for batch in kernels.race_blocks([draw])(iter([batch_of(b) for b in blocks])):
        out += [tuple(p) for p in batch.column("point").to_pylist()]
    return out


def test_race_draws_by_squared_distance_and_copies():
    # distances 1, 2, 3 from the centre, the first point with four copies: weights 4, 4, 9
    points = [[1.0, 0.0]] * 4 + [[0.0, 2.0], [3.0, 0.0], [0.0, 0.0]]
    centre = np.array([[0.0, 0.0]])
    first = Counter(winners([points], (seed, centre, 1))[0] for seed in range(3000))
    assert (0.0, 0.0) not in first
    for point, share in (((1.0, 0.0), 4 / 17), ((0.0, 2.0), 4 / 17), ((3.0, 0.0), 9 / 17)):
        assert abs(first[point] / 3000 - share) < 4 * math.sqrt(share * (1 - share) / 3000)
    assert len(winners([points], (5, centre, 10))) == 3  # each distinct point once
    # copies in several blocks add up: 2 + 2 against one
    first = Counter(winners([[[1.0, 0.0]] * 2 + [[5.0, 5.0]], [[1.0, 0.0]] * 2], (s, None, 1))[0] for s in range(3000))
    assert abs(first[(1.0, 0.0)] / 3000 - 0.8) < 0.03
    assert len(winners([[[1.0, 0.0]] * 2, [[1.0, 0.0]]], (1, None, 5))) == 1


def test_draws_of_tasks_are_those_of_one_task(spark, blobs):
    with packed(blobs, storage="table") as blocks:
        rows = [np.frombuffer(r.block).reshape(-1, r.n).T for r in blocks.collect()]
        centre = np.array([[0.5, 0.5]])
        (got,) = seeding._draw(blocks, [(11, centre, 9)])
        assert [tuple(p) for p in got] == winners(rows, (11, centre, 9))
        (count,) = seeding._weights(blocks, [got])
        points = np.vstack(rows)
        want = np.bincount(((points[:, None] - got) ** 2).sum(axis=2).argmin(axis=1), minlength=9)
        np.testing.assert_array_equal(count, want)


def test_seedings_are_good_and_repeat(spark, blobs, blob_points):
    with packed(blobs, storage="table") as blocks:
        first = seeding.seeded_centres(blocks, 3, [1, 2, 3])
        for a, b in zip(first, seeding.seeded_centres(blocks, 3, [1, 2, 3])):
            np.testing.assert_array_equal(a, b)
    library = KM.fit_kmeans(blobs, k=3, seed=1)
    best = plain_cost(blob_points, library.mixture.means)
    assert all(c.shape == (3, 2) and plain_cost(blob_points, c) < 1.5 * best for c in first)
    fitted = KM.fit_kmeans_seeds(blobs, 3, [1, 2, 3])
    assert fitted.extra["inertia"] == pytest.approx(plain_cost(blob_points, fitted.mixture.means))
    assert fitted.extra["inertia"] <= 1.001 * best and fitted.converged
    assert fitted.extra["inertia"] == min(fitted.extra["inertias"].values()) and len(fitted.extra["inertias"]) == 3


def test_a_third_of_all_rows_alike(spark):
    rows = spark.range(900).select(
        F.when(F.col("id") % 3 == 0, 50.0).otherwise(F.col("id") % 7 / 10).alias("x"),
        F.when(F.col("id") % 3 == 0, -50.0).otherwise(F.col("id") % 11 / 10).alias("y"),
    )
    fitted = KM.fit_kmeans_seeds(rows, 2, [7])
    assert [50.0, -50.0] in fitted.mixture.means.tolist()


def test_few_missing_and_no_points(spark):
    few = spark.createDataFrame([(0.0, 1.0)] * 5 + [(2.0, -0.0), (2.0, 0.0)], "x double, y double")
    (centres,) = seeding.seeded_centres(pack_points(few), 2, [4])
    assert sorted(centres.tolist()) == [[0.0, 1.0], [2.0, 0.0]]
    with pytest.raises(ValueError, match="only 2 distinct points"):
        seeding.seeded_centres(pack_points(few), 3, [4])
    with pytest.raises(NoPoints):
        seeding.seeded_centres(pack_points(few.where("x > 9")), 1, [4])
    with pytest.raises(ValueError, match="NULL or NaN"):
        seeding.seeded_centres(pack_points(few.union(spark.sql("SELECT CAST(NULL AS DOUBLE), 1.0D"))), 1, [4])


def test_many_dimensions_and_seeds_in_one_pass(spark):
    rng = np.random.default_rng(0)
    middle = rng.normal(size=(12, 16)) * 20
    points = middle[rng.integers(0, 12, 2400)] + rng.normal(size=(2400, 16))
    frame = spark.createDataFrame([(p.tolist(),) for p in points], "v array<double>")
    fitted = KM.fit_kmeans_seeds(frame, 12, [0, 1, 2, 3], cols=("v",))
    assert fitted.extra["inertia"] < 1.05 * plain_cost(points, middle)


def test_registered_fit_against_plain_arrays(spark):
    sf = "/root/testdata/sf0.001"
    got = fits.kmeans_seeds(spark, sf).orderBy("component").collect()
    points = np.array(fits._scaled(spark, sf).select("x", "y").collect(), dtype=float)
    centres = np.array([[r.x, r.y] for r in got])
    assert got[0].inertia == pytest.approx(plain_cost(points, centres), rel=1e-4)
    rng, least = np.random.default_rng(1), np.inf
    for _ in range(20):  # plain k-means from random points
        plain = points[rng.choice(len(points), 7, replace=False)]
        for _ in range(100):
            label = ((points[:, None] - plain) ** 2).sum(axis=2).argmin(axis=1)
            plain = np.stack([points[label == j].mean(axis=0) if (label == j).any() else plain[j] for j in range(7)])
        least = min(least, plain_cost(points, plain))
    assert got[0].inertia < 1.03 * least
