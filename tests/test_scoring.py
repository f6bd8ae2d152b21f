import numpy as np
import pytest
from conftest import plain_em_step
from pyspark.sql import functions as F

from mixloom.functions.density import fits_expression
from mixloom.model import Mixture
from mixloom.operators import scoring as S
from mixloom.operators.report import anchor_boxes, component_report, with_anchor
from mixloom.plans.em import fit_em
from mixloom.streaming.scoring import score_stream


@pytest.fixture(scope="module")
def model(blobs, start):
    return fit_em(blobs, start, max_iter=5).mixture


def test_posteriors_equal_textbook(blobs, blob_points, model):
    rows = S.posteriors(blobs, model).orderBy("point_id").collect()
    *_, total, r = plain_em_step(blob_points, model.weights, model.means, model.covs)
    np.testing.assert_allclose([x.posterior for x in rows], r, atol=1e-10)
    assert sum(x.loglik for x in rows) == pytest.approx(total)
    np.testing.assert_allclose([sum(x.posterior) for x in rows], 1.0)


def test_labels_sizes_and_coverage(blobs, blob_points, model, spark):
    *_, r = plain_em_step(blob_points, model.weights, model.means, model.covs)
    expected = r.argmax(axis=1)
    labelled = S.assign(blobs, model)
    got = [x.component for x in labelled.orderBy("point_id").collect()]
    assert got == expected.tolist()
    table = model.to_df(spark)
    sizes = {x.component: x.size for x in S.component_sizes(table, labelled).collect()}
    assert sizes == {k: int((expected == k).sum()) for k in range(3)}
    covered = {x.component: x for x in S.component_coverage(blobs, model).collect()}
    for k in range(3):
        own = blob_points[expected == k] - model.means[k]
        q = np.einsum("ni,ij,nj->n", own, np.linalg.inv(model.covs[k]), own)
        assert covered[k].coverage == pytest.approx((q <= 2).mean())
    assert S.component_points(labelled, 1).count() == sizes[1]


def test_idle_components(spark, blobs, model):
    far = Mixture(
        np.append(model.weights, 1e-9),
        np.vstack([model.means, [[-900.0, -900.0]]]),
        np.concatenate([model.covs, np.eye(2)[None]]),
    )
    labelled = S.assign(blobs, far)
    table = far.to_df(spark)
    assert [r.component for r in S.empty_components(table, labelled).collect()] == [3]
    assert sorted(r.component for r in S.active_components(table, labelled).collect()) == [0, 1, 2]
    sizes = {r.component: r.size for r in S.component_sizes(table, labelled).collect()}
    assert sizes[3] == 0


def test_ties_go_to_the_lowest_component(spark, blobs):
    twin = Mixture.at_points([[0.3, 0.3], [0.3, 0.3]])
    assert S.assign(blobs, twin).filter("component <> 0").count() == 0


def test_outlier_has_a_finite_likelihood(spark, model):
    far = spark.createDataFrame([(1, 1e6, -1e6)], "point_id bigint, x double, y double")
    row = S.posteriors(far, model).first()
    assert np.isfinite(row.loglik) and sum(row.posterior) == pytest.approx(1)


def test_long_form_and_window_agree(blobs, model):
    long = S.posteriors_long(blobs, model).select("point_id", "component", "posterior")
    scored = S.with_log_density(blobs, model).select(
        "point_id", F.posexplode("log_density").alias("component", "log_density")
    )
    window = S.normalise_long(scored).select(
        "point_id", "component", F.col("posterior").alias("other")
    )
    gap = long.join(window, ["point_id", "component"]).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("posterior") - F.col("other"))).alias("gap")
    ).first()
    assert gap.n == 3 * blobs.count() and gap.gap < 1e-12


def test_large_models_are_scored_in_arrow(spark):
    rng = np.random.default_rng(5)
    points = rng.normal(size=(200, 12))
    frame = spark.createDataFrame(
        [(i, p.tolist()) for i, p in enumerate(points)], "point_id bigint, features array<double>"
    )
    model = Mixture.at_points(points[:4])
    assert not fits_expression(model)
    *_, total, r = plain_em_step(points, model.weights, model.means, model.covs)
    rows = S.posteriors(frame, model, cols=("features",)).orderBy("point_id").collect()
    np.testing.assert_allclose([x.posterior for x in rows], r, atol=1e-10)
    covered = S.component_coverage(frame, model, q=12.0, cols=("features",)).collect()
    label = r.argmax(axis=1)
    for row in covered:
        own = points[label == row.component] - model.means[row.component]
        assert row.inside == int(((own**2).sum(axis=1) <= 12.0).sum())


def test_many_components_use_the_array_functions(blobs, blob_points):
    model = Mixture.at_points(blob_points[:70])
    *_, r = plain_em_step(blob_points, model.weights, model.means, model.covs)
    rows = S.posteriors(blobs, model).orderBy("point_id").collect()
    np.testing.assert_allclose([x.posterior for x in rows], r, atol=1e-10)


def test_scoring_is_one_generated_stage_without_shuffle(spark, model, tmp_path, blobs):
    path = str(tmp_path / "p")
    blobs.write.parquet(path)
    df = S.posteriors(spark.read.parquet(path), model).select("point_id", "posterior")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    assert {line.strip(" +-:")[:4] for line in plan.splitlines() if "Project" in line} == {"*(1)"}


def test_report_restores_units_and_sorts(spark):
    model = Mixture(
        [0.25, 0.75], [[0.9, 0.1], [0.2, 0.5]], [np.eye(2) * 0.01, [[0.04, 0.01], [0.01, 0.09]]]
    )
    scales = [(10.0, 110.0), (-5.0, 5.0)]
    rows = component_report(model.to_df(spark), scales).collect()
    assert [r.component for r in rows] == [1, 0] and [r.rank for r in rows] == [0, 1]
    np.testing.assert_allclose(rows[0].mean, [30.0, 0.0])
    np.testing.assert_allclose(rows[0].cov, [[400.0, 10.0], [10.0, 9.0]])
    table = spark.createDataFrame([(1, -5.0, 5.0), (0, 10.0, 110.0)], "dim int, min double, max double")
    again = component_report(model.to_df(spark), table).collect()
    np.testing.assert_allclose(again[0].cov, rows[0].cov)


def test_anchor_boxes_are_centred(spark, blobs, model):
    boxes = {r.component: r for r in anchor_boxes(model.to_df(spark)).collect()}
    for k, (w, h) in enumerate(model.means):
        assert (boxes[k].left, boxes[k].bottom) == pytest.approx((-w / 2, -h / 2))
        assert (boxes[k].width, boxes[k].height) == pytest.approx((w, h))
    joined = with_anchor(S.assign(blobs, model), model.to_df(spark))
    assert joined.count() == blobs.count()


def test_stream_gets_the_batch_scores(spark, blobs, model, tmp_path):
    source = str(tmp_path / "in")
    blobs.write.parquet(source)
    stream = spark.readStream.schema(blobs.schema).parquet(source)
    query = (
        score_stream(stream, model)
        .writeStream.format("memory")
        .queryName("scored")
        .option("checkpointLocation", str(tmp_path / "cp"))
        .outputMode("append")
        .start()
    )
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    got = {r.point_id: (r.component, r.loglik) for r in spark.table("scored").collect()}
    batch = S.posteriors(S.assign(blobs, model), model)
    assert got == {r.point_id: (r.component, r.loglik) for r in batch.collect()}
