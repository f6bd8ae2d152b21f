import numpy as np
import pytest
from conftest import plain_em_step
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from mixloom.model import DegenerateComponent, Mixture
from mixloom.operators.vectors import to_features
from mixloom.plans.blocks import NoPoints, packed, sum_blocks
from mixloom.plans.em import em_step, fit_em, log_likelihood
from mixloom.plans.mllib import fit_mllib


def close(a: Mixture, weights, means, covs, tol=1e-9):
    np.testing.assert_allclose(a.weights, weights, atol=tol)
    np.testing.assert_allclose(a.means, means, atol=tol)
    np.testing.assert_allclose(a.covs, covs, atol=tol)


def test_step_equals_textbook(blobs, blob_points, start):
    model, loglik = em_step(blobs, start)
    w, m, c, ll, _ = plain_em_step(blob_points, start.weights, start.means, start.covs)
    close(model, w, m, c)
    assert loglik == pytest.approx(ll)


def test_fit_equals_textbook_and_likelihood_rises(blobs, blob_points, start):
    result = fit_em(blobs, start, max_iter=12, final_loglik=True)
    w, m, c = start.weights, start.means, start.covs
    logliks = []
    for _ in range(12):
        w, m, c, ll, _ = plain_em_step(blob_points, w, m, c)
        logliks.append(ll)
    close(result.mixture, w, m, c, 1e-7)
    got = [e.loglik for e in result.history]
    np.testing.assert_allclose(got, logliks, rtol=1e-9)
    assert all(b >= a - 1e-9 for a, b in zip(got, got[1:]))
    assert result.final_loglik >= got[-1]
    assert result.n_points == len(blob_points)
    assert result.mixture.weights.sum() == pytest.approx(1)
    assert (np.linalg.eigvalsh(result.mixture.covs) > 0).all()


def test_recovers_the_clouds(blobs, start):
    means = fit_em(blobs, start, max_iter=40).mixture.means
    np.testing.assert_allclose(means, [[0.2, 0.2], [0.8, 0.3], [0.5, 0.8]], atol=0.03)


@pytest.mark.parametrize("storage", ["memory", "table", "none"])
def test_storage_kinds_agree(blobs, start, storage):
    base = fit_em(blobs, start, max_iter=2).mixture
    other = fit_em(blobs, start, max_iter=2, storage=storage).mixture
    close(other, base.weights, base.means, base.covs)


def test_layout_does_not_matter(blobs, start):
    base = fit_em(blobs, start, max_iter=4).mixture
    for frame in (blobs.repartition(7), blobs.coalesce(1), blobs.orderBy("x")):
        other = fit_em(frame, start, max_iter=4).mixture
        close(other, base.weights, base.means, base.covs)


def test_array_column_and_larger_dimension(spark):
    rng = np.random.default_rng(1)
    points = rng.normal(size=(400, 5))
    rows = [(i, p.tolist()) for i, p in enumerate(points)]
    frame = spark.createDataFrame(rows, "point_id bigint, features array<double>")
    start = Mixture.at_points(points[:3])
    model, loglik = em_step(frame, start, cols=("features",))
    w, m, c, ll, _ = plain_em_step(points, start.weights, start.means, start.covs)
    close(model, w, m, c)
    assert loglik == pytest.approx(ll)
    names = [f"f{i}" for i in range(5)]
    wide = frame.selectExpr(*[f"features[{i}] AS f{i}" for i in range(5)])
    close(em_step(wide, start, cols=names)[0], w, m, c)
    again = to_features(wide, names)
    close(em_step(again, start, cols=("features",))[0], w, m, c)


def test_odd_dimension_density(spark):
    frame = spark.createDataFrame([(0.0,), (1.0,)], "x double")
    model = Mixture([1.0], [[0.0]], [[[1.0]]])
    expected = 2 * -0.5 * np.log(2 * np.pi) - 0.5
    assert log_likelihood(frame, model, cols=("x",)) == pytest.approx(expected)


def test_narrow_data_far_from_zero_keep_their_digits(spark, blob_points, start):
    far = blob_points * 1e-3 + 1e6
    frame = spark.createDataFrame([(float(x), float(y)) for x, y in far], "x double, y double")
    near = far - 1e6
    covs = np.tile(np.eye(2) * 1e-8, (3, 1, 1))
    means = start.means * 1e-3
    model, loglik = em_step(frame, Mixture(start.weights, means + 1e6, covs))
    w, m, c, ll, _ = plain_em_step(near, start.weights, means, covs)
    assert loglik == pytest.approx(ll, rel=1e-6)
    np.testing.assert_allclose(model.means - 1e6, m, atol=1e-9)
    np.testing.assert_allclose(model.covs, c, rtol=1e-4, atol=1e-13)


def test_a_task_gets_its_blocks_in_parts(spark, blobs, start, monkeypatch):
    from mixloom.functions import kernels
    from mixloom.plans import blocks as B

    made = kernels.fold_blocks

    def watched(arguments):
        fold = made(arguments)

        def run(batches):
            def seen():
                for batch in batches:
                    if batch.num_rows > 10:
                        raise RuntimeError(f"{batch.num_rows} blocks at once")
                    yield batch

            yield from fold(seen())

        return run

    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(rows), spark.conf.get(size)
    whole = sum_blocks(blobs.select("x", "y"), start)
    spark.conf.set(rows, "4")
    try:
        with packed(blobs) as blocks:
            assert blocks.count() == 150
            spark.conf.set(rows, before[0])
            monkeypatch.setattr(kernels, "fold_blocks", watched)
            monkeypatch.setattr(B, "PASS_BYTES", 512, raising=False)
            sums = sum_blocks(blocks, start)
    finally:
        spark.conf.set(rows, before[0])
    np.testing.assert_allclose(sums.second, whole.second)
    assert sums.count == whole.count == 600 and spark.conf.get(size) == before[1]


@pytest.mark.parametrize("d", [1, 2, 3, 4])
def test_sums_by_monomials_equal_sums_of_whitened_points(d, monkeypatch):
    from mixloom.functions import kernels

    rng = np.random.default_rng(d)
    points = rng.random((d, 5000)) + 1e5
    root = rng.normal(size=(4, d, d)) * 0.1
    model = Mixture(np.array([0.1, 0.2, 0.3, 0.4]), points.T[:4], root @ root.transpose(0, 2, 1) + 0.01 * np.eye(d))
    whiten, constant = model.whitening()
    folds = []
    for bound in (kernels.NEAR_MIDDLE, -1.0):  # no mean is near enough for the second
        monkeypatch.setattr(kernels, "NEAR_MIDDLE", bound)
        folds.append(kernels.Fold(whiten, model.means, constant, False))
        for lo in (0, 37, 1500):  # slices of odd lengths
            folds[-1].add(points[:, lo : {0: 37, 37: 1500, 1500: None}[lo]])
    quick, plain = folds
    assert quick.monomials and not plain.monomials
    np.testing.assert_allclose(quick.table(), plain.table(), rtol=1e-9, atol=1e-9 * 5000)
    assert quick.total == pytest.approx(plain.total, rel=1e-12) and quick.count == plain.count
    monkeypatch.setattr(kernels, "NEAR_MIDDLE", 1e5)
    # narrow components far apart are summed point by point, as is a choice of one component
    assert not kernels.Fold(whiten * 1e4, model.means, constant, False).monomials
    assert not kernels.Fold(whiten, model.means, constant, True).monomials


def test_tolerance_stops_early(blobs, start, blob_points):
    total = fit_em(blobs, start, max_iter=50, tol=1.0)
    assert total.converged and len(total.history) < 50
    a, b = total.history[-2].loglik, total.history[-1].loglik
    assert abs(b - a) < 1.0
    mean = fit_em(blobs, start, max_iter=50, tol=1.0, tol_kind="mean")
    assert len(mean.history) < len(total.history)
    with pytest.raises(ValueError):
        fit_em(blobs, start, tol_kind="median")


def test_far_outlier_does_not_break_the_likelihood(spark, blobs, start):
    far = spark.createDataFrame([(-1, 1e4, 1e4)], blobs.schema)
    model, loglik = em_step(blobs.unionByName(far), start)
    assert np.isfinite(loglik) and loglik < -1e7
    assert np.isfinite(model.means).all()


def test_single_component_is_mean_and_covariance(blobs, blob_points):
    model, _ = em_step(blobs, Mixture.at_points([[0.0, 0.0]]))
    close(
        model,
        [1.0],
        [blob_points.mean(axis=0)],
        [np.cov(blob_points.T, bias=True)],
    )


def test_equal_starts_stay_equal(blobs):
    twin = Mixture.at_points([[0.3, 0.3], [0.3, 0.3]])
    model = fit_em(blobs, twin, max_iter=3).mixture
    np.testing.assert_allclose(model.means[0], model.means[1])


def test_singular_covariance_is_named(spark):
    line = spark.createDataFrame([(float(i), 2.0 * i) for i in range(10)], "x double, y double")
    with pytest.raises(DegenerateComponent, match="component 0") as caught:
        fit_em(line, Mixture.at_points([[1.0, 2.0]]), max_iter=3)
    assert len(caught.value.history) == 1 and caught.value.last_model is not None
    assert fit_em(line, Mixture.at_points([[1.0, 2.0]]), max_iter=3, reg_covar=1e-6).history


def test_null_points_and_no_points_are_refused(spark, start):
    with pytest.raises(ValueError, match="NULL or NaN"):
        em_step(spark.createDataFrame([(1.0, None)], "x double, y double"), start)
    with pytest.raises(NoPoints):
        em_step(spark.createDataFrame([], "x double, y double"), start)


def test_dimension_mismatch_is_refused(blobs):
    with pytest.raises(Exception, match="dimensions"):
        em_step(blobs, Mixture.at_points([[0.0, 0.0, 0.0]]))


def test_model_size_is_bounded():
    with pytest.raises(ValueError, match="size"):
        Mixture.at_points(np.zeros((20_000, 2)))


def test_library_trainer_agrees(blobs, start):
    ours = fit_em(blobs, start, max_iter=10).mixture
    theirs = fit_mllib(blobs, start, max_iter=10, final_loglik=True)
    close(theirs.mixture, ours.weights, ours.means, ours.covs, 1e-6)
    assert theirs.final_loglik == pytest.approx(log_likelihood(blobs, ours), rel=1e-6)


def test_one_shuffle_of_fixed_size_per_pass(blobs, start):
    with packed(blobs, storage="none") as blocks:
        sums = sum_blocks(blocks, start)
        assert blocks.columns == ["n", "block"]
        plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("InMemoryTableScan")[0]
    assert sums.first.shape == (3, 2) and sums.second.shape == (3, 2, 2)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(
        st.tuples(st.floats(-5, 5), st.floats(-5, 5)), min_size=4, max_size=30, unique=True
    )
)
def test_any_points_give_weights_that_sum_to_one(spark, points):
    frame = spark.createDataFrame([tuple(map(float, p)) for p in points], "x double, y double")
    start = Mixture.at_points([points[0], points[1]])
    model, loglik = em_step(frame, start, reg_covar=1e-6)
    w, m, c, ll, _ = plain_em_step(
        np.array(points), start.weights, start.means, start.covs, 1e-6
    )
    assert model.weights.sum() == pytest.approx(1)
    close(model, w, m, c, 1e-7)
    assert loglik == pytest.approx(ll)
