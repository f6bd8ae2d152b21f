"""Object-detection annotation documents (nested JSON)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixloom.functions import kernels
from mixloom.schemas import ANNOTATION_DOCUMENT, ANNOTATIONS, CATEGORIES
from mixloom.session import land
from mixloom.sources.ranges import read_arrays

MAX_SPLITS = 1_000


def read_annotations(
    spark: SparkSession, splits: dict[str, str], multi_line: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Categories ``(id, name)`` and annotations of all splits.

    ``splits`` maps a split name to its documents: a file, a folder or a glob of
    shards, each with its own category and annotation lists, one document per line.
    A document that spans lines needs ``multi_line`` and is read by one task; for a
    split that is one large document see ``read_large_annotations``. Crowd
    annotations are kept.
    """
    reader = spark.read.schema(ANNOTATION_DOCUMENT).option("mode", "FAILFAST")
    documents = reduce(
        DataFrame.unionByName,
        [
            reader.option("multiLine", multi_line)
            .json(path)
            .withColumn("split", F.lit(split))
            for split, path in splits.items()
        ],
    )
    return explode_documents(documents)


def read_large_annotations(
    spark: SparkSession, splits: dict[str, str], joined: bool = False
) -> tuple[DataFrame, DataFrame]:
    """As ``read_annotations``, for documents of any size on one line or on many.

    Tasks read byte ranges of a document and find the elements of its two arrays
    themselves, so a single file is read by as many tasks as it has ranges
    (``spark.sql.files.maxPartitionBytes``). ``joined`` takes the files of a split, in the
    order of their names, as parts of one document. A malformed element raises, and
    so does a document that does not close.
    """
    frames = [
        [found.withColumn("split", F.lit(split)) for found in read_arrays(spark, path, ["categories", "annotations"], joined)]
        for split, path in splits.items()
    ]
    categories, annotations = (reduce(DataFrame.unionByName, own) for own in zip(*frames))

    def parsed(elements: DataFrame, kind: str) -> DataFrame:
        record = kind.removeprefix("array<").removesuffix(">")
        found = F.from_json("value", record, {"mode": "FAILFAST"}).alias("r")
        return elements.select("split", found).select("split", "r.*")

    categories = land(parsed(categories, CATEGORIES).drop("split").distinct(), "categories")
    return categories, parsed(annotations, ANNOTATIONS)


def write_large_annotations(categories: DataFrame, annotations: DataFrame, path: str, mode: str = "error") -> None:
    """One document, as text parts whose names give their order.

    Every task writes its own run of elements; joined one after another the parts are
    the document. Lines end elements, which JSON takes as space.
    """
    def texts(rows: DataFrame, columns: list[str], rank: int) -> DataFrame:
        body = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
        return rows.select(F.lit(rank).alias("rank"), body.alias("value"))

    spark = annotations.sparkSession
    marks = [(0, '{"categories":['), (2, '],"annotations":['), (4, "]}")]
    rows = (
        spark.createDataFrame(marks, "rank int, value string")
        .union(texts(categories, ["id", "name"], 1))
        .union(texts(annotations, ["id", "image_id", "category_id", "area", "bbox", "iscrowd"], 3))
    )
    rows = land(rows.withColumn("at", F.monotonically_increasing_id()), "elements")
    # the first element of an array has no comma before it; marks are alone in their rank
    first = {r["rank"]: r["at"] for r in rows.groupBy("rank").agg(F.min("at").alias("at")).collect()}
    lead = F.when(F.col("at").isin(list(first.values())), "").otherwise(",")
    ranged = rows.repartitionByRange("rank", "at").sortWithinPartitions("rank", "at")
    ranged.select(F.concat(lead, "value")).write.mode(mode).text(path)


def explode_documents(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two tables held by documents ``(split, categories, annotations)``.

    Categories are landed: Spark then knows their size, and a join with them
    shuffles the annotations only if the categories are too many to broadcast.
    """
    categories = land(documents.select(F.inline("categories")).distinct(), "categories")
    annotations = documents.select("split", F.inline("annotations"))
    return categories, annotations


def to_documents(
    categories: DataFrame,
    annotations: DataFrame,
    per_document: int = 4096,
    splits: list[str] | None = None,
) -> DataFrame:
    """Nest flat annotations into document rows ``(split, categories, annotations)``.

    Each task nests its own rows in runs of at most ``per_document``: nothing is
    shuffled and no document grows with the data. Categories get documents of
    their own in each split, instead of a copy in every annotation document.
    Without ``splits`` the names are looked up first; each is a folder later.
    """
    if splits is None:
        found = annotations.select("split").distinct().limit(MAX_SPLITS + 1).collect()
        splits = sorted(row["split"] for row in found)
    if not 1 <= len(splits) <= MAX_SPLITS:
        raise ValueError(f"there must be 1 to {MAX_SPLITS} splits")
    nest = kernels.nest_batches(per_document)
    every_split = F.explode(F.array(*[F.lit(s) for s in splits]))
    category_documents = (
        categories.select(every_split.alias("split"), "id", "name")
        .mapInArrow(nest, f"split string, rows {CATEGORIES}")
        .withColumnRenamed("rows", "categories")
    )
    annotation_documents = (
        annotations.select(
            "split", "id", "image_id", "category_id", "area", "bbox", "iscrowd"
        )
        .mapInArrow(nest, f"split string, rows {ANNOTATIONS}")
        .withColumnRenamed("rows", "annotations")
    )
    return annotation_documents.unionByName(
        category_documents, allowMissingColumns=True
    ).select(
        "split",
        F.coalesce("categories", F.expr("array()")).alias("categories"),
        F.coalesce("annotations", F.expr("array()")).alias("annotations"),
    )


def write_annotations(documents: DataFrame, path: str, mode: str = "error") -> None:
    """One folder per split below ``path``, one JSON document per line."""
    documents.select("split", "categories", "annotations").write.mode(
        mode
    ).partitionBy("split").json(path)
