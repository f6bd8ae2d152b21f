"""Models, labels and fit metrics on disk."""

from __future__ import annotations

from pyspark.ml.clustering import GaussianMixtureModel as MLGaussianMixtureModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixloom.model import Mixture, as_mixture
from mixloom.schemas import FIT_HISTORY, LABELS, MODEL, RUNS
from mixloom.sources.ranges import numbered_lines


def save_model(
    model: Mixture | DataFrame, path: str, spark: SparkSession | None = None, if_exists: str = "error"
) -> None:
    """Write the K-row model table. ``ignore`` leaves an existing one alone."""
    if if_exists not in ("error", "ignore", "overwrite"):
        raise ValueError("if_exists must be 'error', 'ignore' or 'overwrite'")
    if isinstance(model, Mixture):
        if spark is None:
            raise ValueError("saving a Mixture needs the session")
        model = model.to_df(spark)
    mode = "errorifexists" if if_exists == "error" else if_exists
    model.select("component", "weight", "mean", "cov").coalesce(1).write.mode(mode).parquet(path)


def load_model(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MODEL).parquet(path)


def from_ml(model: MLGaussianMixtureModel) -> Mixture:
    """Take over a model fitted or loaded by ``pyspark.ml``."""
    rows = model.gaussiansDF.collect()
    return Mixture(
        list(model.weights),
        [r["mean"].toArray() for r in rows],
        [r["cov"].toArray() for r in rows],
    )


def to_ml(spark: SparkSession, model: Mixture | DataFrame) -> MLGaussianMixtureModel:
    """The model as a ``pyspark.ml`` transformer, which can also be saved."""
    model = as_mixture(model)
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    linalg = jvm.org.apache.spark.ml.linalg
    gaussian = jvm.org.apache.spark.ml.stat.distribution.MultivariateGaussian

    def doubles(values):
        array = gateway.new_array(gateway.jvm.double, len(values))
        for i, v in enumerate(values):
            array[i] = float(v)
        return array

    gaussians = gateway.new_array(gaussian, model.k)
    for i in range(model.k):
        gaussians[i] = gaussian(
            linalg.DenseVector(doubles(model.means[i])),
            linalg.DenseMatrix(model.d, model.d, doubles(model.covs[i].ravel(order="F"))),
        )
    java = jvm.org.apache.spark.ml.clustering.GaussianMixtureModel(
        "mixloom_gmm", doubles(model.weights), gaussians
    )
    wrapped = MLGaussianMixtureModel(java)
    wrapped._resetUid("mixloom_gmm")
    return wrapped


def save_labels(
    labelled: DataFrame, path: str, fmt: str = "parquet", mode: str = "error", by_component: bool = False
) -> None:
    """Write ``(point_id, component)``; ``by_component`` gives each its folder."""
    labels = labelled.select("point_id", "component")
    if fmt == "parquet":
        writer = labels.write.mode(mode)
        (writer.partitionBy("component") if by_component else writer).parquet(path)
    elif fmt == "text":
        labels.select(F.concat_ws(" ", "point_id", "component").alias("value")).write.mode(
            mode
        ).text(path)
    else:
        raise ValueError("fmt must be 'parquet' or 'text'")


def read_labels(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Labels by key. Text lines hold ``point_id component``; blank lines are skipped."""
    if fmt == "parquet":
        return spark.read.schema(LABELS).parquet(path)
    parts = F.split(F.trim("value"), " +")
    return (
        spark.read.text(path)
        .filter(F.trim("value") != "")
        .select(
            F.get(parts, 0).cast("bigint").alias("point_id"),
            F.get(parts, 1).cast("int").alias("component"),
        )
    )


def read_label_lines(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """``(line, component)`` of files that hold one component id a line and no key.

    Also gives the number of lines. What is no whole number raises.
    """
    lines, count = numbered_lines(spark, path)
    return lines.select("line", F.trim("value").cast("int").alias("component")), count


def write_label_lines(labels: DataFrame, path: str, order: str = "point_id", mode: str = "error") -> None:
    """One component id a line, in the order of the ids over all parts."""
    ranged = labels.repartitionByRange(order).sortWithinPartitions(order)
    ranged.select(F.col("component").cast("string")).write.mode(mode).text(path)


def append_history(history: DataFrame, path: str) -> None:
    """Append epochs ``(run_id, epoch, loglik, seconds)``."""
    history.coalesce(1).write.mode("append").parquet(path)


def read_fit_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FIT_HISTORY).parquet(path)


def append_runs(runs: DataFrame, path: str) -> None:
    """Append one row per fit."""
    runs.coalesce(1).write.mode("append").parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUNS).parquet(path)
