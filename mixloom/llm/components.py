"""Connected components of a distributed edge list by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixloom.llm.common import land


def _with_least(edges: DataFrame) -> DataFrame:
    """(u, v) with the least neighbour of u.

    The least neighbour is a map-side combined minimum and returns by a join, so
    that a node with very many neighbours is spread over tasks.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("least"))
    return edges.join(least, "u")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; the component is its least node.

    Nodes are longs. Loops and edges with a null end are ignored; repeated edges
    do no harm. Each round hangs neighbours on smaller ones (large star, small
    star) and is landed, so lineage does not grow; rounds are about the logarithm
    of the component size. An empty edge list gives an empty table.
    """
    pairs = edges.select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    ).where((F.col(a) != F.col(b)) & F.col(a).isNotNull() & F.col(b).isNotNull())
    state = land(pairs.distinct(), "edges")
    mark = _mark(state)
    while mark[0]:
        both = state.union(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            _with_least(both)
            .where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.least("least", "u").alias("v"))
            .distinct()
        )
        starred = _with_least(large)
        small = (
            starred.where(F.col("v") != F.col("least"))
            .select(F.col("v").alias("u"), F.col("least").alias("v"))
            .union(starred.select("u", F.col("least").alias("v")))
            .distinct()
        )
        state = land(small, "edges")
        before, mark = mark, _mark(state)
        if before == mark:
            break
    stars = state.select(F.col("u").alias("node"), F.col("v").alias("component"))
    centres = state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.union(centres)


def _mark(state: DataFrame) -> tuple:
    row = state.agg(
        F.count(F.lit(1)),
        F.bit_xor(F.xxhash64("u", "v")),
        F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 31))),
    ).first()
    return tuple(row)
