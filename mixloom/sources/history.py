"""Ragged histories: three files of ``{category: [values]}`` aligned by position."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixloom.schemas import HISTORY_CHUNK, HISTORY_WHOLE
from mixloom.sources.ranges import read_lists

VALUES = ("wh", "hw", "area")


def write_history(
    history: DataFrame, path: str, chunk_rows: int = 8192, mode: str = "error"
) -> None:
    """Write ``(category, pos, wh, hw, area)`` as one folder per value name.

    Each line is ``{"start": p, "values": {category: [...]}}``: a run of at most
    ``chunk_rows`` values starting at position ``p``, so no line grows with the
    data however many values a category has.
    """
    chunk = F.expr(f"pos div {int(chunk_rows)}").alias("_chunk")
    runs = history.groupBy("category", chunk).agg(
        F.min("pos").alias("start"),
        F.sort_array(F.collect_list(F.struct("pos", *VALUES))).alias("_run"),
    )
    documents = F.array(
        *[
            F.struct(
                F.lit(name).alias("name"),
                F.create_map("category", F.col("_run").getField(name)).alias("values"),
            )
            for name in VALUES
        ]
    )
    runs.select("start", F.inline(documents)).write.mode(mode).partitionBy(
        "name"
    ).json(path)


def to_whole_json(history: DataFrame) -> DataFrame:
    """The three single-object documents ``(name, value)``.

    Everything is in one string, so this is for small histories only;
    ``write_whole_history`` writes the same objects in parts.
    """
    lists = history.groupBy("category").agg(
        F.sort_array(F.collect_list(F.struct("pos", *VALUES))).alias("_run")
    )
    maps = lists.agg(
        *[
            F.to_json(
                F.map_from_entries(
                    F.collect_list(F.struct("category", F.col("_run").getField(v)))
                )
            ).alias(v)
            for v in VALUES
        ]
    )
    pairs = ", ".join(f"'{v}', {v}" for v in VALUES)
    return maps.selectExpr(f"stack({len(VALUES)}, {pairs}) AS (name, value)")


def _chunks(spark: SparkSession, path: str, whole: bool) -> DataFrame:
    if not whole:
        return spark.read.schema(HISTORY_CHUNK).json(path)
    text = spark.read.option("wholetext", True).text(path)
    return text.select(
        F.lit(0).cast("bigint").alias("start"),
        F.from_json("value", HISTORY_WHOLE).alias("values"),
    )


def _lists(chunks: DataFrame, name: str) -> DataFrame:
    return chunks.select("start", F.explode("values").alias("category", name))


def read_history(
    spark: SparkSession, paths: str | dict[str, str], whole: bool = False
) -> DataFrame:
    """Read the three files into ``(category, pos, wh, hw, area)``.

    ``paths`` is the folder of ``write_history`` or a file per value name.
    ``whole=True`` reads the form with one JSON object per file. The lists are
    matched by category and start before they are spread into rows, so the joins
    move whole lists; a position missing in one list is NULL.
    """
    if isinstance(paths, str):
        paths = {name: f"{paths}/name={name}" for name in VALUES}
    first, second, third = (
        _lists(_chunks(spark, paths[name], whole), name) for name in VALUES
    )
    keys = ["category", "start"]
    joined = first.join(second, keys, "full").join(third, keys, "full")
    empty = F.array().cast("array<double>")
    zipped = F.arrays_zip(*[F.coalesce(v, empty).alias(v) for v in VALUES])
    return joined.select(
        "category", "start", F.posexplode(zipped).alias("_i", "_v")
    ).select(
        "category",
        (F.col("start") + F.col("_i")).alias("pos"),
        *[F.col("_v").getField(v).alias(v) for v in VALUES],
    )


def write_whole_history(history: DataFrame, path: str, mode: str = "error") -> None:
    """Write ``(category, pos, wh, hw, area)`` as the three objects ``{category: [..]}``.

    Each value name gets a folder of text parts; joined in the order of their names
    they are one JSON object, with line ends for spaces. Parts are ranges of category
    and position, so a category that holds most values is spread over many. Positions
    must count from 0 in each category without gaps; an empty history writes ``{}``.
    """
    spark = history.sparkSession
    bounds = history.agg(
        F.min("category"), F.max(F.struct("category", "pos")), F.count(F.when(F.col("category").isNull(), 1))
    ).first()
    if bounds[2]:
        raise ValueError("a category without a name cannot be written")
    if bounds[1] is None:
        for name in VALUES:
            spark.createDataFrame([("{}",)], "value string").coalesce(1).write.mode(mode).text(f"{path}/name={name}")
        return
    first, last = bounds[0], bounds[1]
    ranged = history.repartitionByRange("category", "pos").sortWithinPartitions("category", "pos")
    # a name as JSON text, quotes and all, out of a list of one
    quoted = F.to_json(F.array("category"))
    opening = F.concat(
        F.when(F.col("category") == first, "{").otherwise("],"), F.substring(quoted, F.lit(2), F.length(quoted) - 2), F.lit(":[")
    )
    before = F.when(F.col("pos") == 0, opening).otherwise(",")
    is_last = (F.col("category") == last["category"]) & (F.col("pos") == last["pos"])
    for name in VALUES:
        text = F.coalesce(F.col(name).cast("string"), F.lit("null"))
        line = F.concat(before, text, F.when(is_last, "]}").otherwise(""))
        ranged.select(line.alias("value")).write.mode(mode).text(f"{path}/name={name}")


def read_whole_history(spark: SparkSession, paths: str | dict[str, str], joined: bool = False) -> DataFrame:
    """Read three objects ``{category: [..]}`` of any size into ``(category, pos, wh, hw, area)``.

    Tasks read byte ranges cut at commas, within a list too. ``paths`` is the folder of
    ``write_whole_history``, whose parts are joined, or a file for each value name. A
    position missing in one list is NULL, as is a null; what is no number raises.
    """
    if isinstance(paths, str):
        paths, joined = {name: f"{paths}/name={name}" for name in VALUES}, True
    keys = ["category", "pos"]
    first, second, third = (
        read_lists(spark, paths[name], joined).select(
            F.col("key").alias("category"), "pos", F.nullif(F.col("value"), F.lit("null")).cast("double").alias(name)
        )
        for name in VALUES
    )
    return first.join(second, keys, "full").join(third, keys, "full").select(*keys, *VALUES)
