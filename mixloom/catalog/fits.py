"""Starts, fits, reports and comparisons."""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import GaussianMixtureModel
from pyspark.sql import Window
from pyspark.sql import functions as F

from mixloom.catalog import oracle as O
from mixloom.catalog import views as V
from mixloom.catalog.registry import model_columns, query, rounded
from mixloom.functions.columns import digest_word, seeded_digest
from mixloom.model import Mixture
from mixloom.operators.augment import augment
from mixloom.operators.features import category_history, reconstruct_sides
from mixloom.operators.report import component_report
from mixloom.operators.scaling import compute_scales, fix_scales, minmax_scale
from mixloom.operators.starts import initial_mixture, initial_model, sample_starts
from mixloom.plans import kmeans as KM
from mixloom.plans.em import em_step, fit_em
from mixloom.plans.minibatch import BATCH_SIZE, STEPS, fit_minibatch
from mixloom.plans.mllib import fit_mllib
from mixloom.plans.trainers import compare_trainers, sweep
from mixloom.session import landing_path
from mixloom.sources.models import (
    append_history,
    append_runs,
    from_ml,
    load_model,
    read_fit_history,
    read_runs,
    save_model,
    to_ml,
)
from mixloom.sources.points import write_points
from mixloom.streaming.steps import read_version, step_stream

K = 7


def _scaled(spark, sf_dir):
    points = V.pts_orders(spark, sf_dir)
    return minmax_scale(points, fix_scales(compute_scales(points)))


def _start(points, k: int) -> Mixture:
    return initial_mixture(sample_starts(points, k, V.SEED), k)


@query(
    "o02_seeded_starts",
    O.Fit(O.PTS_ORDERS, K).sql(
        "SELECT CAST(k AS INT) AS component, id AS point_id, round(x, 6) AS x, round(y, 6) AS y FROM starts"
    ),
)
def seeded_starts(spark, sf_dir):
    return sample_starts(_scaled(spark, sf_dir), K, V.SEED).select(
        "component", "point_id", rounded("x"), rounded("y")
    )


@query(
    "o02_distinct_starts",
    f"""WITH d AS (SELECT x, y, min({{'key': md5(concat_ws(':', id, {V.SEED})), 'id': id}}) AS m
FROM (SELECT event_id AS id, CAST(hour(ts) AS DOUBLE) AS x, CAST(user_id AS DOUBLE) AS y FROM events) GROUP BY x, y)
SELECT CAST(row_number() OVER (ORDER BY m.key, m.id) - 1 AS INT) AS component, m.id AS point_id, x, y
FROM d ORDER BY m.key, m.id LIMIT 12""",
)
def distinct_starts(spark, sf_dir):
    points = V.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("point_id"),
        F.hour("ts").cast("double").alias("x"),
        F.col("user_id").cast("double").alias("y"),
    )
    return sample_starts(points, 12, V.SEED, distinct_starts=True).select(
        "component", "point_id", "x", "y"
    )


@query("m01_initial_model", O.Fit(O.PTS_ORDERS, K).model_sql())
def first_model(spark, sf_dir):
    points = _scaled(spark, sf_dir)
    return model_columns(initial_model(sample_starts(points, K, V.SEED), K))


@query("s11_model_roundtrip", O.Fit(O.PTS_ORDERS, K).em().model_sql())
def model_saved(spark, sf_dir):
    """A stepped model saved twice (the second time ignored) and loaded."""
    points = _scaled(spark, sf_dir)
    path = landing_path(spark, "model")
    start = _start(points, K)
    save_model(em_step(points, start)[0], path, spark)
    save_model(start, path, spark, if_exists="ignore")
    return model_columns(load_model(spark, path))


@query("s11_library_model_roundtrip", O.Fit(O.PTS_ORDERS, K).em().model_sql())
def library_model_saved(spark, sf_dir):
    """The stepped model as a library transformer, saved and loaded as such."""
    points = _scaled(spark, sf_dir)
    path = landing_path(spark, "library-model")
    to_ml(spark, em_step(points, _start(points, K))[0]).write().save(path)
    return model_columns(from_ml(GaussianMixtureModel.load(path)).to_df(spark))


@query("m03_em_step", O.Fit(O.PTS_ORDERS, K).em().model_sql())
def one_step(spark, sf_dir):
    points = _scaled(spark, sf_dir)
    model, _ = em_step(points, _start(points, K))
    return model_columns(model.to_df(spark))


_EVENT_START = O.Fit(O.PTS_EVENTS, 4)


@query("m03_em_step_events", _EVENT_START.em().em().model_sql())
def event_steps(spark, sf_dir):
    points = V.pts_events(spark, sf_dir)
    points = minmax_scale(points, fix_scales(compute_scales(points)))
    model = _start(points, 4)
    for _ in range(2):
        model, _ = em_step(points, model)
    return model_columns(model.to_df(spark))


def _wide_step_sql(k: int) -> str:
    """One step from identity covariances in 64 dimensions, in long form."""
    return f"""WITH f AS MATERIALIZED (SELECT vec_id AS id, pos, CAST(embedding[pos] AS DOUBLE) AS v
  FROM embeddings, (SELECT unnest(range(1, 65)) AS pos)),
starts AS MATERIALIZED (SELECT row_number() OVER (ORDER BY md5(concat_ws(':', vec_id, {V.SEED})), vec_id) - 1 AS k, vec_id AS id
  FROM embeddings ORDER BY md5(concat_ws(':', vec_id, {V.SEED})), vec_id LIMIT {k}),
g AS MATERIALIZED (SELECT f.id AS id, s.k AS k, exp(-0.5 * sum((f.v - c.v) * (f.v - c.v))) AS g
  FROM starts s JOIN f c ON c.id = s.id JOIN f ON f.pos = c.pos GROUP BY f.id, s.k),
r AS MATERIALIZED (SELECT id, k, g / sum(g) OVER (PARTITION BY id) AS r FROM g),
mu AS MATERIALIZED (SELECT k, pos, sum(r * v) / sum(r) AS mu FROM r JOIN f USING (id) GROUP BY k, pos),
z AS MATERIALIZED (SELECT id, k, pos, v - mu AS z FROM f JOIN mu USING (pos))
SELECT CAST(a.k AS INT) AS component, CAST(a.pos - 1 AS INT) AS i, CAST(b.pos - 1 AS INT) AS j,
  round(sum(r * a.z * b.z) / sum(r), 6) AS cov, round(any_value(m.mu), 6) AS mean_i
FROM z a JOIN z b ON a.id = b.id AND a.k = b.k AND a.pos <= b.pos JOIN r ON r.id = a.id AND r.k = a.k
JOIN mu m ON m.k = a.k AND m.pos = a.pos GROUP BY a.k, a.pos, b.pos"""


@query("m03_em_step_64d", _wide_step_sql(10))
def wide_step(spark, sf_dir):
    points = V.pts_emb(spark, sf_dir)
    cols = ("features",)
    start = initial_mixture(sample_starts(points, 10, V.SEED, cols), 10, cols)
    model = em_step(points, start, cols)[0].to_df(spark)
    rows = model.select(
        "component", F.posexplode("mean").alias("i", "mean_i"), "cov"
    ).select("component", "i", "mean_i", F.posexplode(F.get("cov", F.col("i"))).alias("j", "cov"))
    return rows.filter("i <= j").select(
        "component", "i", "j", rounded("cov"), rounded("mean_i")
    )


@query("m04_em_fit3", O.Fit(O.PTS_ORDERS, K).em().em().em().model_sql())
def three_epochs(spark, sf_dir):
    points = _scaled(spark, sf_dir)
    result = fit_em(points, _start(points, K), max_iter=3)
    return model_columns(result.model_df(spark))


def _epochs(count: int) -> O.Fit:
    fit = O.Fit(O.PTS_ORDERS, K)
    for _ in range(count):
        fit.em()
    return fit


@query("m04_em_fit50", _epochs(50).model_sql())
def fifty_epochs(spark, sf_dir):
    """The whole fit: 50 epochs without tolerance."""
    points = _scaled(spark, sf_dir)
    return model_columns(fit_em(points, _start(points, K), max_iter=50).model_df(spark))


def _history_sql(epochs: int) -> str:
    fit = O.Fit(O.PTS_ORDERS, K)
    for _ in range(epochs):
        fit.em()
    union = " UNION ALL ".join(fit.logliks)
    return fit.sql(
        "SELECT CAST(epoch AS INT) AS epoch, round(loglik, 4) AS loglik, "
        f"round(loglik - lag(loglik) OVER (ORDER BY epoch), 4) AS gain FROM ({union})"
    )


@query("s12_fit_history", _history_sql(50))
def fit_history(spark, sf_dir):
    """Epochs appended to the metrics table and read back with their gain."""
    points = _scaled(spark, sf_dir)
    path = landing_path(spark, "fit-history")
    result = fit_em(points, _start(points, K), max_iter=50)
    append_history(result.history_df(spark, "orders"), path)
    gain = F.col("loglik") - F.lag("loglik").over(
        Window.partitionBy("run_id").orderBy("epoch")
    )
    return read_fit_history(spark, path).select(
        "epoch", rounded("loglik", 4), F.round(gain, 4).alias("gain")
    )


@query("m05_em_mllib", _epochs(50).model_sql(4))
def library_fit(spark, sf_dir):
    points = _scaled(spark, sf_dir)
    result = fit_mllib(points, _start(points, K), max_iter=50)
    return model_columns(result.model_df(spark), 4)


def _minibatch_fit(steps: int) -> O.Fit:
    fit = O.Fit(O.PTS_ORDERS, K)
    for _ in range(steps):
        fit.minibatch(4096, 0.5, 100.0, V.SEED)
    return fit


@query("m06_sgd_step", _minibatch_fit(5).model_sql())
def minibatch_steps(spark, sf_dir):
    """Five steps; with four batches the last one opens the second epoch."""
    points = _scaled(spark, sf_dir)
    result = fit_minibatch(
        points, _start(points, K), steps=5, batch_size=4096, seed=V.SEED
    )
    return model_columns(result.model_df(spark))


def _stream_fit(batches: int) -> O.Fit:
    fit = O.Fit(O.PTS_ORDERS, K)
    for _ in range(batches):
        fit.minibatch(None, 0.5, 100.0, V.SEED, batches=batches)
    return fit


@query("m06_stream_steps", _stream_fit(4).model_sql())
def stream_steps(spark, sf_dir):
    """All points arrive as four hashed parts; each is a micro-batch and moves the model.

    The stream is stopped after each part and goes on with what its folders hold.
    """
    points = _scaled(spark, sf_dir)
    start = _start(points, K)
    path = landing_path(spark, "stream-steps")
    part = digest_word(seeded_digest(F.col("point_id"), V.SEED, 0), 0) % 4
    points.withColumn("part", part).write.partitionBy("part").parquet(f"{path}/all")
    for number in range(4):
        arriving = spark.read.schema(points.schema).parquet(f"{path}/all/part={number}")
        arriving.write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(points.schema).parquet(f"{path}/in")
        step_stream(stream, start, f"{path}/model", f"{path}/progress").awaitTermination()
    return model_columns(read_version(spark, f"{path}/model").mixture.to_df(spark))


@query("m06_sgd_fit", None)
def minibatch_fit(spark, sf_dir):
    """The whole mini-batch job: 2,500 steps of batches of 131,072 points.

    The same steps in SQL take minutes; a test holds them against plain arrays.
    """
    points = _scaled(spark, sf_dir)
    result = fit_minibatch(points, _start(points, K), seed=V.SEED)
    return model_columns(result.model_df(spark))


@query(
    "m07_kmeans_step",
    O.Fit(O.PTS_ORDERS, K)
    .lloyd()
    .lloyd()
    .sql("SELECT CAST(k AS INT) AS component, round(mx, 6) AS x, round(my, 6) AS y FROM m2"),
)
def lloyd_steps(spark, sf_dir):
    points = _scaled(spark, sf_dir)
    centres = _start(points, K).means
    for _ in range(2):
        centres, _ = KM.kmeans_step(points, centres)
    rows = [(i, float(c[0]), float(c[1])) for i, c in enumerate(centres)]
    return spark.createDataFrame(rows, "component int, x double, y double").select(
        "component", rounded("x"), rounded("y")
    )


@query(
    "m07_kmeans_fit",
    O.Fit(O.PTS_ORDERS, K)
    .lloyd_until(1e-4)
    .sql(
        "SELECT CAST(k AS INT) AS component, round(mx, 6) AS x, round(my, 6) AS y, "
        "CAST((SELECT max(round) FROM walk) AS INT) AS epochs FROM mw"
    ),
)
def kmeans_fit(spark, sf_dir):
    """Lloyd rounds from drawn starts until no centre moves."""
    points = _scaled(spark, sf_dir)
    result = KM.fit_kmeans(points, start=_start(points, K))
    rows = [(i, *map(float, c), result.epochs) for i, c in enumerate(result.mixture.means)]
    return spark.createDataFrame(rows, "component int, x double, y double, epochs int").select(
        "component", rounded("x"), rounded("y"), "epochs"
    )


@query("m07_kmeans_seeds", None)
def kmeans_seeds(spark, sf_dir):
    """The best of five k-means fits over shared passes, drawn anew for each seed.

    Draws have no SQL; tests hold them and the inertia against plain arrays.
    """
    result = KM.fit_kmeans_seeds(_scaled(spark, sf_dir), K, [1, 2, 3, 4, 5])
    centres = result.mixture.means
    rows = [(i, *map(float, centres[j]), result.extra["inertia"]) for i, j in enumerate(np.lexsort(centres.T[::-1]))]
    return spark.createDataFrame(rows, "component int, x double, y double, inertia double").select(
        "component", rounded("x"), rounded("y"), rounded("inertia", 4)
    )


@query(
    "m08_warm_em",
    O.Fit(O.PTS_ORDERS, K).lloyd().lloyd().hard_moments(1e-6).em(1e-6).em(1e-6).model_sql(),
)
def warm_em(spark, sf_dir):
    points = _scaled(spark, sf_dir)
    result = KM.fit_em_warm(
        points, start=_start(points, K), kmeans_iter=2, kmeans_tol=0.0, max_iter=2, tol=0.0
    )
    return model_columns(result.model_df(spark))


@query(
    "m08_warm_em_fit",
    O.Fit(O.PTS_ORDERS, K)
    .lloyd_until(1e-4)
    .hard_moments(1e-6)
    .em_until(1e-5, 100, 1e-6)
    .sql(
        "SELECT m.*, CAST((SELECT max(round) FROM walk) AS INT) AS kmeans_epochs, "
        f"CAST((SELECT max(round) FROM climb) AS INT) AS epochs FROM ({O.model_select('mc')}) m"
    ),
)
def warm_em_fit(spark, sf_dir):
    """k-means and EM, both to their tolerances."""
    points = _scaled(spark, sf_dir)
    result = KM.fit_em_warm(points, start=_start(points, K))
    return model_columns(result.model_df(spark)).select(
        "*",
        F.lit(result.extra["kmeans_epochs"]).alias("kmeans_epochs"),
        F.lit(result.epochs).alias("epochs"),
    )


def _report_sql(
    model: str, digits: int, trainer: str | None = None, points: str = O.PTS_ORDERS
) -> str:
    lead = f"'{trainer}' AS trainer, " if trainer else ""
    box = f"(SELECT min(x) AS x0, max(x) - min(x) AS xr, min(y) AS y0, max(y) - min(y) AS yr FROM ({points}))"
    return (
        f"SELECT {lead}CAST(row_number() OVER (ORDER BY mx, k) - 1 AS INT) AS rank, round(w, 6) AS weight, "
        f"round(mx * xr + x0, {digits}) AS mean_x, round(my * yr + y0, {digits}) AS mean_y, "
        f"round(sxx * xr * xr / 1e6, {digits}) AS cov_xx, round(syy * yr * yr, {digits}) AS cov_yy FROM {model}, {box}"
    )


def _report_columns(report, digits, *lead):
    return report.select(
        *lead,
        "rank",
        rounded("weight"),
        F.round(F.get("mean", 0), digits).alias("mean_x"),
        F.round(F.get("mean", 1), digits).alias("mean_y"),
        F.round(F.get(F.get("cov", 0), 0) / F.lit(1e6), digits).alias("cov_xx"),
        F.round(F.get(F.get("cov", 1), 1), digits).alias("cov_yy"),
    )


def _flagship_sql(epochs: int) -> str:
    fit = O.Fit(O.PTS_ORDERS, K)
    for _ in range(epochs):
        fit.em()
    return fit.sql(_report_sql(fit.model, 3))


@query("m11_centroid_report", _flagship_sql(50))
def centroid_report(spark, sf_dir):
    """The main path: scale, draw starts, fit, report in original units."""
    raw = V.pts_orders(spark, sf_dir)
    scales = fix_scales(compute_scales(raw))
    points = minmax_scale(raw, scales)
    result = fit_em(points, _start(points, K), max_iter=50)
    return _report_columns(component_report(result.model_df(spark), scales), 3)


_BOX_POINTS = (
    f"SELECT concat_ws(':', id, copy) AS id, x, y FROM ({O.augmented(O.BOX_SIDES, 2, V.SEED)})"
)
_BOX_FIT = O.Fit(_BOX_POINTS, 5).em_until(0.0, 50)


@query("m11_boxes_to_report", _BOX_FIT.sql(_report_sql(_BOX_FIT.model, 3, points=_BOX_POINTS)))
def boxes_to_report(spark, sf_dir):
    """The whole way: boxes, sides, jittered copies, scales, starts, fit, report."""
    history = category_history(
        V.kept_boxes(spark, sf_dir).withColumn("point_id", V.box_id()), F.lit(0), ["point_id"]
    )
    sides = reconstruct_sides(history).select(
        "point_id", F.col("w").alias("x"), F.col("h").alias("y")
    )
    copies = augment(sides, 2, V.SEED).withColumn(
        "point_id", F.concat_ws(":", "point_id", F.col("copy").cast("string"))
    )
    # landed once: bounds, starts and packing each pass over the copies
    path = landing_path(spark, "copies")
    write_points(copies.select("point_id", "x", "y"), path)
    copies = spark.read.parquet(path)
    scales = fix_scales(compute_scales(copies))
    points = minmax_scale(copies, scales)
    result = fit_em(points, _start(points, 5), max_iter=50)
    return _report_columns(component_report(result.model_df(spark), scales), 3)


def _warm(points: str, k: int, kmeans_rounds: int = 300, rounds: int = 100) -> O.Fit:
    return O.Fit(points, k).lloyd_until(1e-4, kmeans_rounds).hard_moments(1e-6).em_until(1e-5, rounds, 1e-6)


def _comparison_sql() -> str:
    fits = {
        "em": _epochs(50),
        "em_mllib": _epochs(50),
        "sgd": O.Fit(O.PTS_ORDERS, K).minibatch_walk(50, BATCH_SIZE, 0.5, 100.0, V.SEED),
        "kmeans": O.Fit(O.PTS_ORDERS, K).lloyd_until(1e-4).hard_moments(),
        "em_warm": _warm(O.PTS_ORDERS, K),
    }
    return " UNION ALL ".join(
        f"SELECT * FROM ({fit.sql(_report_sql(fit.model, 3, name))})" for name, fit in fits.items()
    )


@query("m12_trainer_comparison", _comparison_sql())
def comparison(spark, sf_dir):
    """All trainers from one start: EM over 50 epochs, k-means and warm EM to their
    tolerances, as many mini-batch steps as EM has epochs."""
    raw = V.pts_orders(spark, sf_dir)
    scales = fix_scales(compute_scales(raw))
    points = minmax_scale(raw, scales).persist()
    report = compare_trainers(
        points,
        ["em", "em_mllib", "sgd", "kmeans", "em_warm"],
        _start(points, K),
        scales,
        {
            "em": {"max_iter": 50},
            "em_mllib": {"max_iter": 50},
            "sgd": {"steps": 50, "seed": V.SEED},
        },
    )
    points.unpersist()
    return _report_columns(report, 3, "trainer")


_GRID = [
    {"trainer": t, "k": k, "aug": a} for a in (0, 1) for k in (2, 3, 7) for t in ("em", "kmeans", "em_warm")
]


def _sweep_sql() -> str:
    parts = []
    for g in _GRID:
        aug = g["aug"]
        points = (
            f"SELECT id * {aug + 1} + copy AS id, x, y FROM "
            f"({O.augmented(O.PTS_PIXELS, aug, V.SEED)})"
        )
        if g["trainer"] == "em":
            fit, epochs = O.Fit(points, g["k"]).em_until(0.0, 50), "50"
        elif g["trainer"] == "kmeans":
            fit = O.Fit(points, g["k"]).lloyd_until(1e-4, 50).hard_moments()
            epochs = "(SELECT max(round) FROM walk)"
        else:
            fit, epochs = _warm(points, g["k"], 50, 50), "(SELECT max(round) FROM climb)"
        fit.loglik()
        body = fit.sql(
            f"SELECT '{g['trainer']}' AS trainer, CAST({g['k']} AS INT) AS k, CAST({aug} AS INT) AS aug, "
            f"(SELECT count(*) FROM p) AS n_points, CAST({epochs} AS INT) AS epochs, round(loglik, 4) AS loglik FROM closing"
        )
        parts.append(f"SELECT * FROM ({body})")
    return " UNION ALL ".join(parts)


@query("m13_sweep", _sweep_sql())
def scalability_sweep(spark, sf_dir):
    """Every fit of the grid over 50 epochs and shared passes, through the run log."""
    options = {
        "em": {"max_iter": 50}, "kmeans": {"max_iter": 50}, "em_warm": {"kmeans_iter": 50, "max_iter": 50},
    }
    runs = sweep(V.pts_pixels(spark, sf_dir), _GRID, V.SEED, options)
    path = landing_path(spark, "runs")
    append_runs(runs, path)
    return read_runs(spark, path).select("trainer", "k", "aug", "n_points", "epochs", rounded("loglik", 4))
