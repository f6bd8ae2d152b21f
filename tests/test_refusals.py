"""Nothing is dropped or read in part without a word."""

import pytest
from pyspark.sql import functions as F

from mixloom.model import Mixture
from mixloom.operators.augment import augment
from mixloom.operators.scaling import minmax_scale
from mixloom.operators.scoring import assign, posteriors
from mixloom.operators.starts import initial_mixture
from mixloom.plans.trainers import sweep
from mixloom.streaming.scoring import score_stream


def grid_model(k):
    return Mixture.at_points([[i / k, (i * 7 % k) / k] for i in range(k)])


ROWS = [(1, 0.1, 0.2), (2, None, 0.2), (3, float("nan"), 0.5), (4, 0.9, None), (5, 0.5, 0.5)]


@pytest.mark.parametrize("k", [2, 300])
def test_points_without_a_coordinate_have_no_component(spark, k):
    df = spark.createDataFrame(ROWS, "point_id long, x double, y double")
    arrays = df.select("point_id", F.array("x", "y").alias("f"))
    nothing = spark.createDataFrame([(6, None)], "point_id long, f array<double>")
    for frame, cols in ((df, ("x", "y")), (arrays.union(nothing), ("f",))):
        for r in score_stream(frame, grid_model(k), cols).collect():
            known = r.point_id in (1, 5)
            assert (r.component is not None) == (r.posterior is not None) == (r.loglik is not None) == known
        assert {r.point_id for r in assign(frame, grid_model(k), cols).where("component is not null").collect()} == {1, 5}


@pytest.mark.parametrize("k", [2, 300])
@pytest.mark.parametrize("values", [[0.1, 0.2, 99.0], [5.0], []])
def test_arrays_of_another_length_raise(spark, k, values):
    df = spark.createDataFrame([(1, values), (2, [0.1, 0.2])], "point_id long, f array<double>")
    with pytest.raises(Exception, match=f"{len(values)} components, not 2"):
        posteriors(df, grid_model(k), ("f",)).collect()
    with pytest.raises(Exception, match=f"{len(values)} components, not 2"):
        minmax_scale(df, [(0.0, 1.0), (0.0, 1.0)], ("f",)).collect()


def test_other_numbers_of_starts_raise(spark):
    df = spark.createDataFrame([(i, float(i), 1.0) for i in range(7)], "component int, x double, y double")
    with pytest.raises(ValueError, match="numbered 0 to 2"):
        initial_mixture(df, 3)
    with pytest.raises(ValueError, match="numbered 0 to 2"):
        initial_mixture(df.where("component in (0, 1, 5)"), 3)
    assert initial_mixture(df, 7).k == 7


def test_sweep_refuses_points_without_coordinates(spark):
    df = spark.createDataFrame([(i, float(i % 9) if i % 5 else None, float(i % 7)) for i in range(60)], "point_id long, x double, y double")
    with pytest.raises(Exception, match="(?i)null|nan|missing|coordinate"):
        sweep(df, [{"trainer": "em", "k": 2, "aug": 0}], 1, {"em": {"max_iter": 2}})


def test_no_copies_keep_the_types(spark):
    df = spark.createDataFrame([(1, 3, 4)], "point_id long, x int, y int")
    types = [dict(augment(df, extra).select("x", "y").dtypes) for extra in (0, 2)]
    assert types[0] == types[1] == {"x": "double", "y": "double"}
