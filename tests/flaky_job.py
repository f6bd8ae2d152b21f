"""Run by test_reruns.py in a process of its own: a master that allows retries.

The input fails on the first attempt of every odd partition, in every job.
"""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import numpy as np  # noqa: E402
from pyspark import TaskContext  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from mixloom.model import Mixture  # noqa: E402
from mixloom.operators.augment import augment  # noqa: E402
from mixloom.operators.positions import with_positions  # noqa: E402
from mixloom.plans.em import fit_em  # noqa: E402
from mixloom.plans.minibatch import fit_minibatch  # noqa: E402
from mixloom.session import build_session, discard_all  # noqa: E402
from mixloom.sources.annotations import to_documents  # noqa: E402


def flaky(batches):
    context = TaskContext.get()
    if context.partitionId() % 2 and context.attemptNumber() == 0:
        raise RuntimeError("lost on purpose")
    yield from batches


def main():
    spark = build_session("mixloom-reruns", master="local[4,3]", shuffle_partitions=4)
    spark.sparkContext.setLogLevel("OFF")
    steady = spark.range(0, 3000, 1, 6).select(
        F.col("id").alias("point_id"),
        ((F.col("id") * 7919) % 1000 / 1000.0).alias("x"),
        ((F.col("id") * 104729) % 997 / 997.0).alias("y"),
    )
    shaky = steady.mapInArrow(flaky, steady.schema)
    start = Mixture.at_points([[0.1, 0.1], [0.9, 0.8]])

    for options in ({}, {"storage": "table"}, {"spread": 3}):
        a = fit_em(steady, start, max_iter=3, **options).mixture
        b = fit_em(shaky, start, max_iter=3, **options).mixture
        np.testing.assert_allclose(a.means, b.means)
    a = fit_minibatch(steady, start, steps=4, batch_size=700).mixture
    b = fit_minibatch(shaky, start, steps=4, batch_size=700).mixture
    np.testing.assert_allclose(a.means, b.means)
    assert augment(shaky, 2).exceptAll(augment(steady, 2)).count() == 0

    grouped = shaky.select((F.col("point_id") % 2).alias("g"), F.lit(1).alias("o"), "point_id")
    placed = with_positions(grouped, "g", ["o", "point_id"]).collect()
    assert len(placed) == 3000
    assert all(r.pos == r.point_id // 2 for r in placed)

    annotations = shaky.select(
        F.lit("val").alias("split"),
        F.col("point_id").alias("id"),
        F.lit(1).cast("bigint").alias("image_id"),
        F.lit(1).cast("bigint").alias("category_id"),
        F.col("x").alias("area"),
        F.array("x", "y", "x", "y").alias("bbox"),
        F.lit(0).alias("iscrowd"),
    )
    categories = spark.createDataFrame([(1, "a")], "id bigint, name string")
    documents = to_documents(categories, annotations, per_document=100, splits=["val"])
    ids = documents.select(F.explode("annotations.id").alias("id"))
    assert ids.count() == 3000 and ids.distinct().count() == 3000
    discard_all(spark)
    spark.stop()
    print("reruns ok")


if __name__ == "__main__":
    main()
