"""Nearest neighbours by randomly rotated one-bit codes.

Each vector, less the mean of all, is turned by a random rotation and kept as the
signs of its components with two correction scalars: its length, and the inner
product of the sign vector with the vector itself. From these the inner product
with a query is estimated without bias, with an error bound that shrinks with the
number of dimensions. Only vectors whose upper bound reaches a query's current
k-th best are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mixloom.llm.common import land, shuffle_partitions

BLOCK = 2048
QUERY_BLOCK = 512
QUERIES_IN_TASK = 16 * QUERY_BLOCK
LEAST_QUERIES = 256
STRIPE = 32 * BLOCK
BOUND = 3.0
_PAIRS = 1 << 14
SEED = 17


def rotation(d: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def valid_vectors(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v array<double>) of the vectors that take part.

    Null, empty and zero vectors and those holding null or non-finite components
    are left out, as are rows with a null id.
    """
    v = F.col(f"`{vector}`").cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        df.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), v.alias("v"))
        .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
        .where(fine & F.exists("v", lambda x: x != 0))
    )


def matrix(column: pa.Array, d: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) != len(column) * d:
        raise ValueError(f"vectors must all have {d} components")
    return flat.reshape(-1, d)


class Codes:
    """Packed signs and correction scalars of a block of vectors."""

    def __init__(self, vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray):
        rest = (vectors - centre) @ turn.T
        d = rest.shape[1]
        self.d = d
        self.length = np.linalg.norm(rest, axis=1)
        self.bits = np.packbits(rest > 0, axis=1)
        unit = rest / np.where(self.length > 0, self.length, 1.0)[:, None]
        self.overlap = np.abs(unit).sum(1) / np.sqrt(d)  # sign vector on the vector itself

    def estimates(self, turned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimated <vector - centre, query> and error unit, of rows by queries.

        ``turned`` holds rotated queries; the error is per unit of query length.
        """
        signs = np.unpackbits(self.bits, axis=1, count=self.d).astype(np.float32) * 2 - 1
        safe = np.maximum(self.overlap, 1e-9)
        found = signs @ turned.T.astype(np.float32)
        found *= (self.length / safe / np.sqrt(self.d)).astype(np.float32)[:, None]
        unit = self.length * np.sqrt(np.maximum(1 - safe**2, 0)) / safe / np.sqrt(max(self.d - 1, 1))
        return found, unit.astype(np.float32)


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products added from the first component on."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += a[:, j] * b[:, j]
    return total


class Best:
    """The k nearest so far of each query of a block."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, centre, turn, k: int):
        self.ids, self.queries, self.k = ids, queries, k
        self.shift = queries @ centre
        self.turned = queries @ turn.T
        self.norm = np.linalg.norm(queries, axis=1)
        self.score = np.full((len(ids), k), -np.inf)
        self.found = np.full((len(ids), k), -1, np.int64)

    def offer(self, ids: np.ndarray, vectors: np.ndarray, codes: Codes, bound: float) -> None:
        estimate, unit = codes.estimates(self.turned)
        estimate[ids[:, None] == self.ids[None, :]] = -np.inf
        norm = self.norm.astype(np.float32)
        # the best by estimate first: they bring the bar close to its final height
        first = min(self.k, len(ids))
        head = np.argpartition(estimate, len(ids) - first, axis=0)[len(ids) - first :]
        query = np.tile(np.arange(len(self.ids)), first)
        row = head.reshape(-1)
        fine = np.isfinite(estimate[row, query])
        self.rerank(ids, vectors, row[fine], query[fine])
        estimate[row, query] = -np.inf
        bar = (self.score[:, -1] - self.shift).astype(np.float32) - 1e-6 * norm
        row, query = np.nonzero(estimate >= bar - bound * np.outer(unit, norm))
        fine = np.isfinite(estimate[row, query])
        self.rerank(ids, vectors, row[fine], query[fine])

    def rerank(self, ids: np.ndarray, vectors: np.ndarray, row: np.ndarray, query: np.ndarray) -> None:
        """Exact products of the given pairs; the best stay."""
        score = np.concatenate(
            [
                exact_products(vectors[row[a : a + _PAIRS]], self.queries[query[a : a + _PAIRS]])
                for a in range(0, len(row), _PAIRS)
            ]
            or [np.empty(0)]
        )
        worth = score >= self.score[query, -1]
        row, query, score = row[worth], query[worth], score[worth]
        order = np.argsort(query, kind="stable")
        row, query, score = row[order], query[order], score[order]
        some, starts = np.unique(query, return_index=True)
        for q, a, b in zip(some, starts, [*starts[1:], len(query)]):
            both = np.concatenate([self.score[q], score[a:b]])
            names = np.concatenate([self.found[q], ids[row[a:b]]])
            best = np.lexsort((names, -both))[: self.k]
            self.score[q], self.found[q] = both[best], names[best]

    def result(self) -> pa.RecordBatch:
        at, place = np.nonzero(np.isfinite(self.score))
        return pa.RecordBatch.from_arrays(
            [pa.array(self.ids[at]), pa.array(self.found[at, place]), pa.array(self.score[at, place])],
            names=["query_id", "vec_id", "score"],
        )


def search(
    df: DataFrame,
    queries: DataFrame,
    k: int = 20,
    bound: float = BOUND,
    vec_id: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of ``df`` nearest to each query row.

    Nearness is the largest inner product; ties go to the smaller id, a query's own
    id is no candidate. Repeated ids are one vector each time they occur, and a
    repeated query id has k rows in all. Vectors of another length than the most
    frequent one take no part. ``bound``
    is the number of error units in a bound: 3 misses about one neighbour in a
    thousand. Every row is coded and offered to every query, in blocks: a task
    holds one block of queries and reads a stripe of blocks of vectors.
    """
    spark = df.sparkSession
    rows = valid_vectors(df, vec_id, vector)
    d = dimension(rows)
    if not d:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("v") == d)
    asked = valid_vectors(queries, vec_id, vector).where(F.size("v") == d)
    centre = np.array(rows.agg(*[F.avg(F.get("v", j)) for j in range(d)]).first(), float)
    turn = rotation(d)
    vector_blocks = land(_blocks(rows, BLOCK, d), "vectors")
    query_blocks = land(_blocks(asked, QUERY_BLOCK, d), "queries")
    n_vectors, n_queries = (x.agg(F.sum("n")).first()[0] or 0 for x in (vector_blocks, query_blocks))
    # long stripes keep the bar high; tasks come from groups of queries first
    stripes = max(1, -(-n_vectors // STRIPE))
    wanted = min(-(-n_queries // LEAST_QUERIES), -(-4 * shuffle_partitions(spark) // stripes))
    groups = max(1, wanted, -(-n_queries // QUERIES_IN_TASK))
    # the stated query set against all rows: a cell is a group of queries and a stripe of vectors
    asking = query_blocks.withColumn("group", F.pmod(F.xxhash64("first", "ids"), F.lit(groups))).withColumn(
        "stripe", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1)))
    )
    offered = vector_blocks.withColumn(
        "stripe", F.pmod(F.xxhash64("first", "ids"), F.lit(stripes))
    ).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    columns = [
        (F.col("group") * stripes + F.col("stripe")).cast("long").alias("cell"),
        "kind", "first", "ids", "data",
    ]
    cells = (
        asking.withColumn("kind", F.lit(0)).select(*columns)
        .union(offered.withColumn("kind", F.lit(1)).select(*columns))
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, asked_here, offers = None, [], []
        best: list[Best] = []

        def joined(parts):
            return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

        def offer():
            if offers and best:
                ids, data = joined(offers)
                codes = Codes(data, centre, turn)
                for b in best:
                    b.offer(ids, data, codes, bound)
            offers.clear()

        for batch in batches:
            for row in batch.to_pylist():
                if row["cell"] != cell:
                    offer()
                    yield from (b.result() for b in best)
                    best, cell, asked_here = [], row["cell"], []
                part = (
                    np.frombuffer(row["ids"], "<i8"),
                    np.frombuffer(row["data"], "<f8").reshape(-1, d),
                )
                if row["kind"] == 0:
                    asked_here.append(part)
                    continue
                if asked_here:
                    ids, data = joined(asked_here)
                    best = [
                        Best(ids[a : a + QUERY_BLOCK], data[a : a + QUERY_BLOCK], centre, turn, k)
                        for a in range(0, len(ids), QUERY_BLOCK)
                    ]
                    asked_here = []
                if sum(len(p[0]) for p in offers) + len(part[0]) > BLOCK:
                    offer()
                offers.append(part)
        offer()
        yield from (b.result() for b in best)

    found = (
        # by number, not by hash: few cells would share tasks while others idle
        cells.repartitionById(min(groups * stripes, 8 * shuffle_partitions(spark)), F.col("cell").cast("int"))
        .sortWithinPartitions("cell", "kind", "first")
        .mapInArrow(scan, "query_id long, vec_id long, score double")
    )
    return nearest(found, k)


def dimension(rows: DataFrame) -> int:
    """The most frequent length of vectors (the smaller of equally frequent ones), 0 if none."""
    top = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return top.d if top else 0


def _blocks(frame: DataFrame, size: int, d: int) -> DataFrame:
    """One row per block of at most ``size`` vectors: ids and components as bytes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                data = matrix(part.column(1), d)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([len(ids)], pa.int64()),
                        pa.array([int(ids[0])], pa.int64()),
                        pa.array([ids.astype("<i8").tobytes()], pa.binary()),
                        pa.array([np.ascontiguousarray(data, "<f8").tobytes()], pa.binary()),
                    ],
                    names=["n", "first", "ids", "data"],
                )

    return frame.mapInArrow(cut, "n long, first long, ids binary, data binary")


def nearest(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query; a query has k rows of each stripe at most."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
