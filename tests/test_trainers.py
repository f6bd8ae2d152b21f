import numpy as np
import pytest
from conftest import plain_em_step
from pyspark.ml.clustering import GaussianMixtureModel as MLGaussianMixtureModel

from mixloom.model import DegenerateComponent, Mixture
from mixloom.plans import kmeans as KM
from mixloom.plans.blocks import packed
from mixloom.plans.em import fit_em
from mixloom.plans.minibatch import fit_minibatch
from mixloom.plans.trainers import compare_trainers, fit, resolve_trainer, sweep
from mixloom.session import discard, landing_path, shared_dir
from mixloom.sources import models as M


def plain_lloyd(points, centres):
    d2 = ((points[:, None] - centres) ** 2).sum(axis=2)
    label = d2.argmin(axis=1)
    moved = np.stack(
        [points[label == k].mean(axis=0) if (label == k).any() else c for k, c in enumerate(centres)]
    )
    return moved, d2.min(axis=1).sum(), label


def test_lloyd_step(blobs, blob_points, start):
    moved, inertia = KM.kmeans_step(blobs, start.means)
    want, cost, _ = plain_lloyd(blob_points, start.means)
    np.testing.assert_allclose(moved, want)
    assert inertia == pytest.approx(cost)


def test_centre_without_points_stays(blobs):
    centres = np.array([[0.2, 0.2], [50.0, 50.0]])
    moved, _ = KM.kmeans_step(blobs, centres)
    np.testing.assert_allclose(moved[1], [50.0, 50.0])


def test_kmeans_from_the_library_and_from_a_start(blobs, start):
    ours = KM.fit_kmeans(blobs, start=start)
    library = KM.fit_kmeans(blobs, k=3, seed=1)
    order = lambda c: c[np.argsort(c[:, 0])]
    np.testing.assert_allclose(
        order(ours.extra["centres"]), order(library.extra["centres"]), atol=1e-3
    )
    costs = [e.loglik for e in ours.history]
    assert ours.converged and all(b <= a + 1e-9 for a, b in zip(costs, costs[1:]))
    with pytest.raises(ValueError):
        KM.fit_kmeans(blobs)


def test_packed_points_and_empty_centres(blobs, start):
    with packed(blobs) as blocks:
        warm = KM.fit_em_warm(blocks, k=3, seed=1)
        plain = KM.fit_em_warm(blobs, k=3, seed=1)
        order = lambda r: r.mixture.means[np.argsort(r.mixture.means[:, 0])]
        np.testing.assert_allclose(order(warm), order(plain), atol=1e-3)
        assert warm.extra["kmeans_converged"] and warm.extra["kmeans_epochs"] >= 1
        stopped = KM.fit_em_warm(blocks, start=start, kmeans_iter=1, max_iter=1)
        assert not stopped.extra["kmeans_converged"] and not stopped.converged
        far = np.array([[0.2, 0.2], [50.0, 50.0]])
        with pytest.raises(DegenerateComponent, match="centre 1"):
            KM.fit_em_warm(blocks, start=far)


def test_warm_start_and_warm_fit(blobs, blob_points, start):
    centres, _, _ = plain_lloyd(blob_points, start.means)
    _, _, label = plain_lloyd(blob_points, centres)
    warm = KM.warm_start(blobs, centres, reg_covar=1e-6)
    np.testing.assert_allclose(warm.weights, np.bincount(label, minlength=3) / len(label))
    np.testing.assert_allclose(warm.means, centres)
    for k in range(3):
        want = np.cov(blob_points[label == k].T, bias=True) + 1e-6 * np.eye(2)
        np.testing.assert_allclose(warm.covs[k], want, atol=1e-12)
    fitted = KM.fit_em_warm(
        blobs, start=start, kmeans_iter=1, kmeans_tol=0.0, max_iter=1, tol=0.0
    ).mixture
    w, m, c, *_ = plain_em_step(blob_points, warm.weights, warm.means, warm.covs, 1e-6)
    np.testing.assert_allclose(fitted.means, m)
    np.testing.assert_allclose(fitted.covs, c)
    full = KM.fit_em_warm(blobs, k=3)
    assert full.converged
    np.testing.assert_allclose(
        np.sort(full.mixture.means[:, 0]), [0.2, 0.5, 0.8], atol=0.03
    )


def test_one_batch_of_everything_is_a_plain_step(blobs, blob_points, start):
    result = fit_minibatch(blobs, start, steps=1, rate=1.0)
    w, m, _, ll, r = plain_em_step(blob_points, start.weights, start.means, start.covs)
    share = r.mean(axis=0)
    want = start.means + (r.T @ blob_points - r.sum(axis=0)[:, None] * start.means) / len(blob_points)
    np.testing.assert_allclose(result.mixture.means, want)
    logits = np.log(start.weights) + share - start.weights
    np.testing.assert_allclose(result.mixture.weights, np.exp(logits) / np.exp(logits).sum())
    assert result.history[0].loglik == pytest.approx(ll)


def test_batches_part_the_points_and_raise_the_likelihood(blobs, start):
    result = fit_minibatch(blobs, start, steps=60, batch_size=150, rate=0.9, decay=200.0)
    from mixloom.plans.em import log_likelihood

    assert log_likelihood(blobs, result.mixture) > log_likelihood(blobs, start)
    assert (np.linalg.eigvalsh(result.mixture.covs) > 0).all()
    again = fit_minibatch(blobs.repartition(6), start, steps=60, batch_size=150, rate=0.9, decay=200.0)
    np.testing.assert_allclose(again.mixture.means, result.mixture.means)
    with pytest.raises(ValueError):
        fit_minibatch(blobs, start, rate=1.5)


def test_batches_with_no_points_are_passed_over(blobs, start):
    few = blobs.limit(5)
    result = fit_minibatch(few.cache(), start, steps=10, batch_size=1)
    assert 1 <= len(result.history) <= 10


def test_names_of_trainers(blobs, start):
    assert {resolve_trainer(n) for n in ("seq", "par", "rdd")} == {"em"}
    assert resolve_trainer("mllib") == "em_mllib"
    with pytest.raises(ValueError, match="unknown trainer"):
        resolve_trainer("magic")
    a = fit(blobs, "rdd", start, max_iter=2).mixture
    b = fit(blobs, "seq", start, max_iter=2).mixture
    np.testing.assert_allclose(a.means, b.means)
    assert fit(blobs, "em_warm", start, max_iter=2).mixture.k == 3


def test_comparison_by_rank(blobs, start):
    table = compare_trainers(
        blobs,
        ["rdd", "mllib", "kmeans"],
        start,
        [(0.0, 1.0), (0.0, 1.0)],
        {"rdd": {"max_iter": 25}, "mllib": {"max_iter": 25}},
    )
    rows = {(r.trainer, r["rank"]): r for r in table.collect()}
    assert len(rows) == 9
    for rank in range(3):
        np.testing.assert_allclose(rows["rdd", rank].mean, rows["mllib", rank].mean, atol=1e-5)
        np.testing.assert_allclose(rows["rdd", rank].mean, rows["kmeans", rank].mean, atol=0.08)


def test_sweep_rows_are_appended(spark, blobs, tmp_path):
    grid = [{"trainer": "em", "k": k, "aug": a} for k in (1, 2) for a in (0, 1)]
    runs = sweep(blobs, grid, seed=3, options={"em": {"max_iter": 2}}).cache()
    rows = {(r.k, r.aug): r for r in runs.collect()}
    assert rows[1, 0].n_points == 600 and rows[2, 1].n_points == 1200
    assert all(r.seconds > 0 and r.epochs == 2 for r in rows.values())
    path = str(tmp_path / "runs")
    M.append_runs(runs, path)
    M.append_runs(runs, path)
    assert M.read_runs(spark, path).count() == 8


def test_model_files(spark, blobs, start, tmp_path):
    path = str(tmp_path / "m")
    model = fit_em(blobs, start, max_iter=2).mixture
    M.save_model(model, path, spark)
    with pytest.raises(Exception, match="already exists"):
        M.save_model(start, path, spark)
    M.save_model(start, path, spark, if_exists="ignore")
    loaded = Mixture.from_df(M.load_model(spark, path))
    np.testing.assert_allclose(loaded.covs, model.covs)
    M.save_model(start.to_df(spark), path, if_exists="overwrite")
    np.testing.assert_allclose(Mixture.from_df(M.load_model(spark, path)).means, start.means)
    with pytest.raises(ValueError):
        M.save_model(start, path, spark, if_exists="append")


def test_model_bridge(spark, blobs, start, tmp_path):
    model = fit_em(blobs, start, max_iter=2).mixture
    bridged = M.to_ml(spark, model)
    back = M.from_ml(bridged)
    np.testing.assert_allclose(back.covs, model.covs)
    path = str(tmp_path / "ml")
    bridged.write().save(path)
    loaded = M.from_ml(MLGaussianMixtureModel.load(path))
    np.testing.assert_allclose(loaded.means, model.means)


def test_label_files(spark, tmp_path):
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 0)], "point_id bigint, component int")
    M.save_labels(labels, str(tmp_path / "t"), fmt="text")
    assert sorted(M.read_labels(spark, str(tmp_path / "t"), "text").collect()) == labels.collect()
    M.save_labels(labels, str(tmp_path / "c"), by_component=True)
    assert sorted(M.read_labels(spark, str(tmp_path / "c")).collect()) == labels.collect()
    only = M.read_labels(spark, str(tmp_path / "c")).filter("component = 0")
    assert "PartitionFilters: [isnotnull(component" in only._jdf.queryExecution().toString()


def test_shared_folder_is_the_session_setting(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        assert shared_dir(spark) == configured.rstrip("/")
    assert landing_path(spark, "a") != landing_path(spark, "a")


def test_landed_tables_are_discarded(spark, blobs, start):
    path = landing_path(spark, "mine")
    blobs.write.parquet(path)
    discard(spark, path)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
    with pytest.raises(ValueError):
        discard(spark, "/somewhere/else")


def test_fit_goes_on_from_a_saved_epoch(spark, blobs, start, tmp_path):
    path = str(tmp_path / "latest")
    fit_em(
        blobs,
        start,
        max_iter=3,
        on_epoch=lambda epoch, model: M.save_model(model, path, spark, if_exists="overwrite"),
    )
    resumed = fit_em(blobs, M.load_model(spark, path), max_iter=2).mixture
    np.testing.assert_allclose(resumed.means, fit_em(blobs, start, max_iter=5).mixture.means)


def test_fit_history_table(spark, blobs, start, tmp_path):
    path = str(tmp_path / "h")
    for run in ("a", "b"):
        M.append_history(fit_em(blobs, start, max_iter=2).history_df(spark, run), path)
    rows = M.read_fit_history(spark, path).orderBy("run_id", "epoch").collect()
    assert [(r.run_id, r.epoch) for r in rows] == [("a", 1), ("a", 2), ("b", 1), ("b", 2)]


def test_fits_share_their_passes(spark, blobs, start, monkeypatch):
    from mixloom.plans import em
    from mixloom.plans.trainers import fit_all

    jobs = []
    counted = em.sum_many
    monkeypatch.setattr(em, "sum_many", lambda blocks, models: jobs.append(len(models)) or counted(blocks, models))
    two = Mixture.at_points([[0.2, 0.2], [0.8, 0.8]])
    wanted = [("em", start, {"max_iter": 9}), ("kmeans", two, {"max_iter": 4, "tol": 0.0}), ("em", two, {"max_iter": 3}),
              ("em_warm", start, {"kmeans_iter": 2, "kmeans_tol": 0.0, "max_iter": 3, "tol": 0.0})]
    results = fit_all(blobs, wanted)
    # k-means ends with a pass for the groups; the longest fit has nine
    assert jobs == [4, 4, 4, 3, 3, 2, 1, 1, 1]
    for (name, at, options), (together, seconds) in zip(wanted, results):
        alone = fit(blobs, name, at, **options)
        np.testing.assert_allclose(together.mixture.means, alone.mixture.means)
        np.testing.assert_allclose(together.mixture.covs, alone.mixture.covs)
        assert together.epochs == alone.epochs and seconds > 0


def test_equal_requests_are_summed_once(blobs, start, monkeypatch):
    from mixloom.functions import kernels
    from mixloom.plans.trainers import fit_all

    summed, made = [], kernels.fold_blocks
    monkeypatch.setattr(kernels, "fold_blocks", lambda models: summed.append(len(models)) or made(models))
    options = {"max_iter": 3, "tol": 0.0}
    warm = {"kmeans_iter": 3, "kmeans_tol": 0.0, "max_iter": 2, "tol": 0.0}
    together = fit_all(blobs, [("em", start, {"max_iter": 4}), ("kmeans", start, options), ("em_warm", start, warm)])
    # EM and the centres both k-means ask for; then warm EM alone
    assert summed == [2, 2, 2, 2, 1, 1]
    monkeypatch.setattr(kernels, "fold_blocks", made)
    for (name, own), (result, _) in zip([("em", {"max_iter": 4}), ("kmeans", options), ("em_warm", warm)], together):
        alone = fit(blobs, name, start, **own)
        np.testing.assert_allclose(result.mixture.means, alone.mixture.means)
        np.testing.assert_allclose(result.mixture.covs, alone.mixture.covs)


def test_a_failing_fit_lets_the_others_end(blobs, start):
    from mixloom.plans.blocks import packed
    from mixloom.plans.em import em_rounds, run_together

    far = Mixture(np.array([0.5, 0.5]), np.array([[0.5, 0.5], [1e6, 1e6]]), np.tile(1e-4 * np.eye(2), (2, 1, 1)))
    with packed(blobs) as blocks:
        bad, good = run_together(blocks, [em_rounds(far, 5), em_rounds(start, 5)])
    assert isinstance(bad, DegenerateComponent) and "epoch 1" in str(bad) and bad.last_model is far
    np.testing.assert_allclose(good.mixture.means, fit(blobs, "em", start, max_iter=5).mixture.means)


@pytest.mark.parametrize("batch", [150, 4096])
def test_runs_of_steps_equal_steps_as_jobs(blobs, start, batch):
    seen = []
    jobs = fit_minibatch(blobs, start, steps=9, batch_size=batch, seed=4, steps_per_job=1)
    runs = fit_minibatch(
        blobs, start, steps=9, batch_size=batch, seed=4, steps_per_job=4, on_run=lambda n, m: seen.append((n, m))
    )
    np.testing.assert_allclose(runs.mixture.means, jobs.mixture.means)
    np.testing.assert_allclose(runs.mixture.covs, jobs.mixture.covs)
    assert [e.epoch for e in runs.history] == [e.epoch for e in jobs.history]
    np.testing.assert_allclose([e.loglik for e in runs.history], [e.loglik for e in jobs.history])
    assert [n for n, _ in seen] == [4, 8, 9]
    # a fit whose driver was lost goes on from the model it saved
    rest = fit_minibatch(blobs, seen[0][1], steps=9, batch_size=batch, seed=4, first=4)
    np.testing.assert_array_equal(rest.mixture.means, runs.mixture.means)


def test_whole_minibatch_job(spark):
    """The registered 2,500 steps against plain arrays."""
    from mixloom.catalog import fits

    sf = "/root/testdata/sf0.001"
    points = fits._scaled(spark, sf)
    rows = points.select("x", "y").toPandas().to_numpy()
    model = fits._start(points, fits.K)
    w, m, c = model.weights, model.means, model.covs
    for step in range(2500):
        diff = rows[:, None] - m
        z = np.einsum("nki,kij,nkj->nk", diff, np.linalg.inv(c), diff)
        r = w * np.exp(-0.5 * z) / np.sqrt(np.linalg.det(c))
        r /= r.sum(1, keepdims=True)
        rate, share = 0.5 / (1 + step / 100), r.mean(0)
        first = np.einsum("nk,nki->ki", r, diff) / len(rows)
        second = np.einsum("nk,nki,nkj->kij", r, diff, diff) / len(rows)
        m, c = m + rate * first, (1 - rate * share)[:, None, None] * c + rate * second
        w = np.exp(np.log(w) + rate * (share - w))
        w /= w.sum()
    got = fits.minibatch_fit(spark, sf).orderBy("component").collect()
    np.testing.assert_allclose([(g.weight, g.mean_x, g.mean_y) for g in got], np.column_stack([w, m]), atol=2e-6)
    np.testing.assert_allclose([(g.cov_xx, g.cov_xy, g.cov_yy) for g in got], c.reshape(-1, 4)[:, [0, 1, 3]], atol=2e-6)


def test_run_length_is_bounded_by_what_a_task_holds():
    from mixloom.plans.minibatch import BATCH_SIZE, HELD, _run_length

    assert _run_length(10**12, BATCH_SIZE, 10**12 // BATCH_SIZE, 2) == 64
    assert _run_length(10_000, BATCH_SIZE, 1, 2) == 1024
    run = _run_length(600_000, BATCH_SIZE, 5, 2)
    assert 600_000 * (2 + run // 5 + 2) <= HELD < 600_000 * (2 + 2 * run // 5 + 2)


def test_batches_reach_the_steps_as_few_blocks():
    import pyarrow as pa

    from mixloom.functions import kernels

    rng = np.random.default_rng(5)
    keys, points = rng.integers(0, 25, 9_000), rng.random((2, 9_000))
    rows = pa.RecordBatch.from_arrays([pa.array(keys), *map(pa.array, points)], names=["key", "x", "y"])
    packed = list(kernels.pack_keyed_runs(3, 20)(rows.slice(lo, 100) for lo in range(0, 9_000, 100)))
    assert [b.column(0).to_pylist() for b in packed] == [list(range(3, 20))]  # not one row a point
    found = dict(kernels.by_key(packed[0].slice(lo, 5) for lo in range(0, packed[0].num_rows, 5)))
    assert sorted(found) == list(range(3, 20))
    assert all(np.array_equal(found[k], points[:, keys == k]) for k in found)


def test_runs_of_points_in_one_partition_use_all_cores(blobs, start, monkeypatch):
    from mixloom.plans import minibatch

    seen = []
    plain = minibatch._run_steps
    monkeypatch.setattr(
        minibatch, "_run_steps", lambda points, *a: (seen.append(points.rdd.getNumPartitions()), plain(points, *a))[1]
    )
    one = fit_minibatch(blobs.coalesce(1), start, steps=9, batch_size=150, seed=4, steps_per_job=4)
    assert seen == [4, 4, 4]
    many = fit_minibatch(blobs, start, steps=9, batch_size=150, seed=4, steps_per_job=9)
    np.testing.assert_allclose(one.mixture.covs, many.mixture.covs, rtol=1e-9)
    assert [e.epoch for e in one.history] == [e.epoch for e in many.history]
