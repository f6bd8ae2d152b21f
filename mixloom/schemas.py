"""Explicit schemas of every table the toolkit reads or writes."""

from __future__ import annotations

CATEGORIES = "array<struct<id:bigint,name:string>>"

ANNOTATIONS = (
    "array<struct<id:bigint,image_id:bigint,category_id:bigint,"
    "area:double,bbox:array<double>,iscrowd:int>>"
)

ANNOTATION_DOCUMENT = f"categories {CATEGORIES}, annotations {ANNOTATIONS}"

SCALES = "dim int, min double, max double"

MODEL = "component int, weight double, mean array<double>, cov array<array<double>>"

MODEL_VERSION = f"version bigint, step bigint, points bigint, loglik double, {MODEL}"

STARTS = "component int, point_id bigint, mean array<double>"

LABELS = "point_id bigint, component int"

HISTORY_CHUNK = "start bigint, values map<string,array<double>>"

HISTORY_WHOLE = "map<string,array<double>>"

FIT_HISTORY = "run_id string, epoch int, loglik double, seconds double"

RUNS = (
    "run_id string, trainer string, k int, aug int, seed bigint, master string,"
    "n_points bigint, epochs int, loglik double, seconds double"
)
