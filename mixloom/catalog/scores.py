"""Scoring with a fixed model."""

from __future__ import annotations

from pyspark.sql import functions as F

from mixloom.catalog import oracle as O
from mixloom.catalog import views as V
from mixloom.catalog.registry import query, rounded
from mixloom.operators import scoring as S
from mixloom.operators.report import with_anchor
from mixloom.session import landing_path
from mixloom.sources.models import read_labels, save_labels, write_label_lines
from mixloom.sources.points import read_labelled_points, write_points
from mixloom.streaming.scoring import score_stream


def _labelled(spark, sf_dir, idle=False):
    model = V.recorded_model_with_idle() if idle else V.recorded_model()
    return S.assign(V.pts_pixels(spark, sf_dir), model), model.to_df(spark)


@query(
    "m02_log_density",
    O.scored() + "SELECT id AS point_id, CAST(k AS INT) AS component, round(ld, 6) AS log_density FROM d",
)
def log_density(spark, sf_dir):
    scored = S.with_log_density(V.pts_pixels(spark, sf_dir), V.recorded_model())
    return scored.select(
        "point_id", F.posexplode("log_density").alias("component", "_v")
    ).select("point_id", "component", rounded("_v", alias="log_density"))


@query(
    "m09_posteriors",
    O.scored()
    + """SELECT id AS point_id, round(sum(CASE WHEN k = 0 THEN r END), 6) AS r0,
  round(sum(CASE WHEN k = 1 THEN r END), 6) AS r1, round(sum(CASE WHEN k = 2 THEN r END), 6) AS r2,
  round(max(loglik), 6) AS loglik FROM r GROUP BY id""",
)
def posteriors(spark, sf_dir):
    scored = S.posteriors(V.pts_pixels(spark, sf_dir), V.recorded_model())
    return scored.select(
        "point_id",
        *[F.round(F.get("posterior", i), 6).alias(f"r{i}") for i in range(3)],
        rounded("loglik"),
    )


_LONG = O.scored() + "SELECT id AS point_id, CAST(k AS INT) AS component, round(r, 6) AS posterior FROM r"


@query("a08_posteriors_long", _LONG)
def posteriors_long(spark, sf_dir):
    long = S.posteriors_long(V.pts_pixels(spark, sf_dir), V.recorded_model())
    return long.select("point_id", "component", rounded("posterior"))


@query("w02_posterior_window", _LONG)
def posterior_window(spark, sf_dir):
    scored = S.with_log_density(V.pts_pixels(spark, sf_dir), V.recorded_model())
    long = scored.select(
        "point_id", F.posexplode("log_density").alias("component", "log_density")
    )
    return S.normalise_long(long).select("point_id", "component", rounded("posterior"))


@query(
    "a09_log_likelihood",
    O.scored()
    + "SELECT count(*) AS n_points, round(sum(loglik), 3) AS loglik, round(avg(loglik), 6) AS mean_loglik "
    "FROM (SELECT DISTINCT id, loglik FROM r)",
)
def log_likelihood(spark, sf_dir):
    scored = S.posteriors(V.pts_pixels(spark, sf_dir), V.recorded_model())
    return scored.agg(
        F.count(F.lit(1)).alias("n_points"),
        F.round(F.sum("loglik"), 3).alias("loglik"),
        F.round(F.avg("loglik"), 6).alias("mean_loglik"),
    )


_LABELS = O.scored() + "SELECT id AS point_id, CAST(k AS INT) AS component FROM lab"


@query("m10_labels", _LABELS)
def labels(spark, sf_dir):
    return _labelled(spark, sf_dir)[0].select("point_id", "component")


@query("w03_labels_long", _LABELS)
def labels_long(spark, sf_dir):
    scored = S.with_log_density(V.pts_pixels(spark, sf_dir), V.recorded_model())
    return S.assign_long(
        scored.select(
            "point_id", F.posexplode("log_density").alias("component", "log_density")
        )
    )


@query(
    "m09_stream_scores",
    O.scored()
    + """SELECT l.id AS point_id, CAST(l.k AS INT) AS component, round(r.loglik, 6) AS loglik
FROM lab l JOIN r ON r.id = l.id AND r.k = l.k""",
)
def stream_scores(spark, sf_dir):
    """A folder of points as a stream, scored and appended until none is left."""
    path = landing_path(spark, "stream-scores")
    points = V.pts_pixels(spark, sf_dir)
    points.write.parquet(f"{path}/in")
    stream = spark.readStream.schema(points.schema).parquet(f"{path}/in")
    scored = score_stream(stream, V.recorded_model())
    scored.select("point_id", "component", rounded("loglik")).writeStream.format(
        "parquet"
    ).option("checkpointLocation", f"{path}/progress").option(
        "path", f"{path}/table"
    ).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/table")


@query("s10_labels_roundtrip", _LABELS)
def labels_saved(spark, sf_dir):
    path = landing_path(spark, "labels")
    save_labels(_labelled(spark, sf_dir)[0], path)
    return read_labels(spark, path)


@query("s10_labels_text_roundtrip", _LABELS)
def labels_text(spark, sf_dir):
    path = landing_path(spark, "labels")
    save_labels(_labelled(spark, sf_dir)[0], path, fmt="text")
    return read_labels(spark, path, fmt="text")


@query(
    "j05_labels_by_line",
    O.scored() + "SELECT row_number() OVER (ORDER BY id) - 1 AS point_id, round(x, 6) AS x, round(y, 6) AS y, "
    "CAST(k AS INT) AS component FROM lab",
)
def labels_by_line(spark, sf_dir):
    """Points and keyless labels from files that are cut differently, matched by line."""
    path = landing_path(spark, "lines")
    labelled, _ = _labelled(spark, sf_dir)
    ordered = labelled.repartitionByRange(5, "point_id").sortWithinPartitions("point_id")
    write_points(ordered, f"{path}/points", fmt="text")
    write_label_lines(labelled, f"{path}/labels")
    return read_labelled_points(spark, f"{path}/points", f"{path}/labels", n_cols=2).select(
        "point_id", rounded("x"), rounded("y"), "component"
    )


@query(
    "p11_component_points",
    O.scored() + "SELECT id AS point_id, round(x, 6) AS x, round(y, 6) AS y FROM lab WHERE k = 1",
)
def component_points(spark, sf_dir):
    labelled, _ = _labelled(spark, sf_dir)
    return S.component_points(labelled, 1).select("point_id", rounded("x"), rounded("y"))


@query(
    "a13_sizes",
    O.scored(idle=True)
    + "SELECT CAST(m.k AS INT) AS component, count(l.id) AS size FROM model m LEFT JOIN lab l ON l.k = m.k GROUP BY m.k",
)
def component_sizes(spark, sf_dir):
    labelled, model = _labelled(spark, sf_dir, idle=True)
    return S.component_sizes(model, labelled)


@query(
    "a14_coverage",
    O.scored()
    + "SELECT CAST(k AS INT) AS component, count(*) AS size, CAST(sum(CASE WHEN q <= 2 THEN 1 ELSE 0 END) AS BIGINT) AS inside, "
    "round(avg(CASE WHEN q <= 2 THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM lab GROUP BY k",
)
def coverage(spark, sf_dir):
    covered = S.component_coverage(V.pts_pixels(spark, sf_dir), V.recorded_model())
    return covered.select("component", "size", "inside", rounded("coverage"))


@query(
    "j06_active_components",
    O.scored(idle=True)
    + "SELECT CAST(k AS INT) AS component, w AS weight FROM model WHERE k IN (SELECT k FROM lab)",
)
def active(spark, sf_dir):
    labelled, model = _labelled(spark, sf_dir, idle=True)
    return S.active_components(model, labelled).select("component", "weight")


@query(
    "j06_empty_components",
    O.scored(idle=True)
    + "SELECT CAST(k AS INT) AS component, w AS weight FROM model WHERE k NOT IN (SELECT k FROM lab)",
)
def empty(spark, sf_dir):
    labelled, model = _labelled(spark, sf_dir, idle=True)
    return S.empty_components(model, labelled).select("component", "weight")


@query(
    "p07_anchor_boxes",
    O.scored()
    + """SELECT l.id AS point_id, CAST(l.k AS INT) AS component, round(-mx / 2, 6) AS "left",
  round(-my / 2, 6) AS bottom, round(mx, 6) AS width, round(my, 6) AS height FROM lab l JOIN model m ON l.k = m.k""",
)
def anchors(spark, sf_dir):
    labelled, model = _labelled(spark, sf_dir)
    return with_anchor(labelled, model).select(
        "point_id",
        "component",
        rounded("left"),
        rounded("bottom"),
        rounded("width"),
        rounded("height"),
    )
