"""Small helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixloom.session import discard, landing_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries run in here give up their shuffle files when they end.

    For landings: the frame that was written is read from its files afterwards, and
    never computed again.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def land(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = path or landing_path(spark, label)
    with freed_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pack(values: np.ndarray) -> bytes:
    """An integer array as compressed bytes; byte planes keep small numbers small."""
    values = np.ascontiguousarray(values)
    width = values.dtype.itemsize
    planes = values.view(np.uint8).reshape(-1, width).T
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes, dtype) -> np.ndarray:
    dtype = np.dtype(dtype)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    planes = raw.reshape(dtype.itemsize, -1).T
    return np.ascontiguousarray(planes).view(dtype).reshape(-1)


def join_labels(labels: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
    """Union the given pairs in place; a label is the smallest index of its set."""
    while True:
        a, b = labels[left], labels[right]
        differ = a != b
        if not differ.any():
            return
        left, right, a, b = left[differ], right[differ], a[differ], b[differ]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            further = labels[labels]
            if np.array_equal(further, labels):
                break
            labels[:] = further


def land_by(
    df: DataFrame, key: str, label: str, path: str | None = None, compression: str = "zstd"
) -> DataFrame:
    """Land in buckets of ``key``, so that joins on it do not shuffle this side.

    The table's name is of this session only; its files lie in the shared folder.
    """
    spark = df.sparkSession
    path = path or landing_path(spark, label)
    name = f"{label}_{path[-32:]}"
    with freed_shuffles(spark):
        (
            df.write.format("parquet").option("compression", compression).option("path", path)
            .bucketBy(shuffle_partitions(spark), key).saveAsTable(name)
        )
    return spark.table(name)


def discard_buckets(spark: SparkSession, label: str, path: str) -> None:
    """Remove what ``land_by`` landed there, once nothing reads it any more."""
    spark.sql(f"DROP TABLE IF EXISTS {label}_{path[-32:]}")
    discard(spark, path)


def spare(name: str, taken: list[str]) -> str:
    """``name``, made longer until no column has it."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hand at most so many rows at once to Python tasks of this session.

    The default of 10,000 is made for short rows; documents of many kilobytes would
    take hundreds of megabytes outside the heap. A smaller setting is kept.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if not 0 < now <= rows:
        spark.conf.set(key, str(rows))


def with_text(docs: DataFrame, carry: list[str], text: str) -> tuple[DataFrame, int]:
    """The carried columns and the text, which is not sent twice, and where it stands."""
    columns = [F.col(f"`{c}`") for c in carry]
    if text in carry:
        return docs.select(*columns), carry.index(text)
    return docs.select(*columns, F.col(f"`{text}`").alias(spare("_text", carry))), len(carry)
