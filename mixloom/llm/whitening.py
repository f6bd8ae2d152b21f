"""Whitening by the exact characteristic polynomial of an integer scatter matrix.

Vectors become whole numbers, so their scatter (n times the sum of products less the
product of sums, which is n^2 times the covariance) is an exact integer matrix. Tasks
add its entries up in limbs. Its characteristic polynomial is found modulo many primes,
one Hessenberg reduction each, dealt out to tasks, and put together by Chinese
remainders. All roots are real, so the sign changes of the polynomial shifted to a point
count exactly how many lie above it: bisection isolates each root, the sign of the
polynomial at dyadic points refines it to far more digits than a double holds.
Components are null vectors at the roots, by inverse iteration in long decimals.

The driver holds numbers and matrices of the dimension's size only.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import Decimal, localcontext
from math import comb, gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mixloom.llm.common import bounded_batches, land, shuffle_partitions, spare

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 16
ROOT_BITS = 96  # of a root, relative to its size
_LIMB = 30
_EXACT = 1 << 53  # whole numbers below are exact as doubles
_LONG = 1 << 63
_LARGEST = float(1 << 56)  # 64 times as much still is a long


@dataclass
class Whitening:
    """What a fit gives; vectors are columns, largest eigenvalue first."""

    n: int = 0
    sums: list[int] = field(default_factory=list)  # of x less the shift
    eigenvalues: list[float] = field(default_factory=list)
    explained: list[float] = field(default_factory=list)
    components: np.ndarray = field(default_factory=lambda: np.empty((0, 0)))
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly: int64 where it fits, else Python's whole numbers."""
        top = max(int(np.abs(x).max(initial=0)), 1)
        if 2 * top * self.n < _LONG and 2 * max(map(abs, self.sums), default=0) < _LONG:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def project(self, centred: np.ndarray) -> np.ndarray:
        """Whitened coordinates of rows of ``centred``."""
        return (centred / self.n).astype(float) @ (self.components / np.sqrt(self.eigenvalues))


def whole_vector(column: Column, scale: int = SCALE, shift: int = SHIFT) -> Column:
    """floor(scale * c) + shift of each entry; null for vectors that take no part.

    Those are null, empty, or hold an entry that is null, not finite or too large for
    a long (2^56 and above).
    """
    fine = F.forall(column, lambda c: F.coalesce(F.abs(c.cast("double")) < _LARGEST, F.lit(False)))
    whole = F.transform(column, lambda c: F.floor(c.cast("double") * F.lit(float(scale))) + F.lit(shift).cast("long"))
    return F.when((F.size(column) > 0) & fine, whole)


def _rows(values: pa.Array, shift: int) -> np.ndarray:
    """A list column of one width as a matrix, less the shift."""
    flat = values.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(values), -1) - shift


def scatter(fit: DataFrame, shift: int = SHIFT) -> tuple[int, list[int], list[list[int]]]:
    """n, the sums and the matrix n * sum(x x^T) - S S^T of a column of whole vectors.

    Exact for any size of entries: sums leave the tasks as limbs of 30 bits, which
    add up as longs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = _rows(batch.column(0), shift)
            x = np.hstack([x, np.ones((len(x), 1), np.int64)])  # the last column counts and sums
            top = int(np.abs(x).max(initial=0))
            if len(x) * top * top < _EXACT:
                part = (x.T.astype(float) @ x.astype(float)).astype(np.int64).astype(object)
            else:
                part = x.T.astype(object) @ x.astype(object)
            total = part if total is None else total + part
        out: list[tuple] = []
        if total is not None:
            for i in range(len(total)):
                for j in range(i, len(total)):
                    value, limb = int(total[i, j]), 0
                    sign, value = (-1 if value < 0 else 1), abs(value)
                    while value or (limb == 0 and i == j):
                        out.append((i, j, limb, sign * (value & ((1 << _LIMB) - 1))))
                        value, limb = value >> _LIMB, limb + 1
        columns = list(zip(*out)) or [()] * 4
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(c, pa.int32()) for c in columns[:3]), pa.array(columns[3], pa.int64())],
            names=["i", "j", "limb", "value"],
        )

    limbs = fit.mapInArrow(run, "i int, j int, limb int, value long")
    found: dict[tuple, int] = defaultdict(int)
    for row in limbs.groupBy("i", "j", "limb").agg(F.sum("value").alias("value")).collect():
        found[row.i, row.j] += row["value"] << (_LIMB * row.limb)
    d = max((j for _, j in found), default=0)
    n, sums = found[d, d], [found[i, d] for i in range(d)]
    matrix = [[n * found[min(i, j), max(i, j)] - sums[i] * sums[j] for j in range(d)] for i in range(d)]
    return n, sums, matrix


def primes_below(limit: int, product: int) -> list[int]:
    """Primes from ``limit`` (at most 2^31) downwards until their product is reached."""
    found, reached, at = [], 1, limit
    while reached <= product:
        at -= 1
        if at % 2 and all(pow(b, at - 1, at) == 1 for b in (2, 3, 5, 7)) and _is_prime(at):
            found.append(at)
            reached *= at
    return found


def _is_prime(n: int) -> bool:
    """Strong tests to the bases 2, 3, 5 and 7 decide below 3,215,031,751."""
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, n)
        if x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(twos - 1)):
            return False
    return True


def polynomial_modulo(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients, constant first, of the characteristic polynomial modulo a prime."""
    h, d = matrix % p, len(matrix)
    for j in range(d - 2):  # similar to a matrix with zeros below the first subdiagonal
        below = np.flatnonzero(h[j + 1 :, j])
        if not len(below):
            continue
        pivot = j + 1 + int(below[0])
        if pivot != j + 1:
            h[[j + 1, pivot]] = h[[pivot, j + 1]]
            h[:, [j + 1, pivot]] = h[:, [pivot, j + 1]]
        times = h[j + 2 :, j] * pow(int(h[j + 1, j]), -1, p) % p
        h[j + 2 :] = (h[j + 2 :] - times[:, None] * h[j + 1] % p) % p
        h[:, j + 1] = (h[:, j + 1] + (h[:, j + 2 :] * times % p).sum(1)) % p
    poly = np.zeros((d + 1, d + 1), np.int64)  # of the leading blocks
    poly[0, 0] = 1
    for k in range(d):
        # the products of subdiagonal entries from each row down to this one
        weights, chain = np.empty(k + 1, np.int64), 1
        for i in range(k, -1, -1):
            weights[i] = int(h[i, k]) * chain % p
            chain = chain * int(h[i, i - 1]) % p if i else 0
        poly[k + 1, 1:] = poly[k, :-1]
        poly[k + 1] = (poly[k + 1] - (weights[:, None] * poly[: k + 1] % p).sum(0)) % p
    return poly[d]


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Exact coefficients, constant first, for a positive semidefinite integer matrix.

    The elementary symmetric functions of roots that are not negative are largest
    where all roots are equal, which bounds every coefficient and so the primes needed.
    """
    d, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    bound = max(comb(d, k) * trace**k // d**k + 1 for k in range(d + 1))
    primes = primes_below(1 << 31, 2 * bound)
    rows = spark.sparkContext.broadcast(matrix)  # d x d numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.array(rows.value, object)
        for batch in batches:
            own = batch.column(0).to_pylist()
            found = [polynomial_modulo((whole % p).astype(np.int64), p).tolist() for p in own]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["p", "c"])

    dealt = spark.createDataFrame([(p,) for p in primes], "p long").repartition(
        min(len(primes), max(shuffle_partitions(spark), spark.sparkContext.defaultParallelism))
    )
    residues = {r.p: r.c for r in dealt.mapInArrow(run, "p long, c array<long>").collect()}
    modulus = 1
    for p in primes:
        modulus *= p
    out = [0] * (d + 1)
    for p in primes:
        share = modulus // p
        share *= pow(share, -1, p)
        for k, c in enumerate(residues[p]):
            out[k] = (out[k] + c * share) % modulus
    return [c - modulus if 2 * c > modulus else c for c in out]


def roots_above(poly: list[int], at: int, bits: int) -> int:
    """How many roots, each as often as it occurs, lie above at / 2^bits.

    The polynomial has real roots only; moved to the point, its sign changes are then
    exactly as many as its positive roots.
    """
    d = len(poly) - 1
    moved = [c << (bits * (d - k)) for k, c in enumerate(poly)]
    for i in range(d):
        for k in range(d - 1, i - 1, -1):
            moved[k] += at * moved[k + 1]
    signs = [c > 0 for c in moved if c]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def _positive(poly: list[int], at: int, bits: int) -> bool:
    d = len(poly) - 1
    value, scale = poly[d], 0
    for k in range(d - 1, -1, -1):
        scale += bits
        value = value * at + (poly[k] << scale)
    return value > 0


def isolate_root(poly: list[int], k: int, precision: int = ROOT_BITS) -> tuple[int, int, int]:
    """(low, bits, multiplicity): the k-th largest root lies in (low, low + 1] / 2^bits.

    Halving by counts goes on until the root is alone, then by the polynomial's sign.
    Roots that agree in ``precision`` bits count as one with their number.
    """
    top = sum(abs(c) for c in poly[-2:]).bit_length()  # no root exceeds their sum
    low, bits = 0, -top
    above_low, above_high = _count(poly, low, bits), 0
    if above_low < k:
        raise ValueError("there are fewer positive roots")
    while low.bit_length() < precision:
        low, bits = 2 * low, bits + 1
        if above_low - above_high == 1:
            # between single roots the sign says on which side a point lies
            upper = _positive_at(poly, low + 1, bits) == (k % 2 == 0) and not _root_at(poly, low + 1, bits)
            low += upper
            continue
        above = _count(poly, low + 1, bits)
        if above >= k:
            low, above_low = low + 1, above
        else:
            above_high = above
    return low, bits, above_low - above_high


def _scaled(at: int, bits: int) -> tuple[int, int]:
    return (at, bits) if bits >= 0 else (at << -bits, 0)


def _count(poly, at, bits) -> int:
    return roots_above(poly, *_scaled(at, bits))


def _positive_at(poly, at, bits) -> bool:
    return _positive(poly, *_scaled(at, bits))


def _root_at(poly, at, bits) -> bool:
    at, bits = _scaled(at, bits)
    d, scale, value = len(poly) - 1, 0, poly[-1]
    for k in range(d - 1, -1, -1):
        scale += bits
        value = value * at + (poly[k] << scale)
    return value == 0


def null_vectors(matrix: list[list[int]], root: Decimal, many: int, digits: int) -> np.ndarray:
    """``many`` orthonormal columns that the matrix less ``root`` all but annuls."""
    d = len(matrix)
    with localcontext() as context:
        context.prec = digits
        a = np.array([[Decimal(v) for v in row] for row in matrix], object)
        a[np.arange(d), np.arange(d)] -= root
        least = max(abs(v) for v in a.ravel()).scaleb(-digits) or Decimal(1).scaleb(-digits)
        order = list(range(d))
        for j in range(d):  # triangular factors, row swaps in ``order``
            pivot = max(range(j, d), key=lambda i: abs(a[i, j]))
            if pivot != j:
                a[[j, pivot]] = a[[pivot, j]]
                order[j], order[pivot] = order[pivot], order[j]
            if abs(a[j, j]) < least:
                a[j, j] = least
            if j + 1 < d:
                a[j + 1 :, j] /= a[j, j]
                a[j + 1 :, j + 1 :] -= a[j + 1 :, j, None] * a[j, j + 1 :]
        found: list[np.ndarray] = []
        for m in range(many):
            v = np.array([Decimal(1 + (i * (m + 2) * 7919 + m * 104729) % 997) for i in range(d)], object)
            for _ in range(3):
                for u in found:
                    v = v - u * (u * v).sum()
                v = v[order]
                for j in range(d):
                    v[j + 1 :] -= a[j + 1 :, j] * v[j]
                for j in range(d - 1, -1, -1):
                    v[j] /= a[j, j]
                    v[:j] -= a[:j, j] * v[j]
                v = v / (v * v).sum().sqrt()
            for u in found:
                v = v - u * (u * v).sum()
            v = v / (v * v).sum().sqrt()
            found.append(v if max(v, key=abs) > 0 else -v)
        return np.array([[float(x) for x in v] for v in found]).T


def fit_whitening(
    vectors: DataFrame,
    column: str = "embedding",
    components: int = COMPONENTS,
    scale: int = SCALE,
    shift: int = SHIFT,
) -> Whitening:
    """Fit on each distinct whole vector once.

    Vectors as in ``whole_vector`` take no part; if none are left the fit is empty.
    Components of zero variance cannot be whitened and are left out, so there are as
    many as the rank at most, none for a single distinct vector. Vectors of unlike
    lengths raise ValueError. Other columns play no part.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    x = whole_vector(F.col(f"`{column}`"), scale, shift)
    fit = land(vectors.select(x.alias("x")).where("x IS NOT NULL").distinct(), "whole_vectors")
    widths = fit.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if widths[0] is None:
        return Whitening()
    if widths[0] != widths[1]:
        raise ValueError(f"vectors of {widths[0]} and of {widths[1]} entries in one table")
    n, sums, matrix = scatter(fit, shift)
    common = gcd(*(v for row in matrix for v in row))
    if not common:
        return Whitening(n, sums, components=np.empty((len(sums), 0)), eigenvalues=[])
    matrix = [[v // common for v in row] for row in matrix]
    poly = characteristic_polynomial(spark, matrix)
    rank = len(matrix) - next(k for k, c in enumerate(poly) if c)
    count = min(components, rank)
    poly = poly[len(matrix) - rank :]

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_pylist()
            low, bits, many = zip(*(isolate_root(shared.value, k) for k in own))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(str, low), pa.string()), pa.array(bits, pa.int32()), pa.array(many, pa.int32())],
                names=["k", "low", "bits", "many"],
            )

    shared = spark.sparkContext.broadcast(poly)
    dealt = spark.range(1, count + 1, 1, count)
    isolated = sorted(dealt.mapInArrow(roots, "k long, low string, bits int, many int").collect())
    # one row a different root: how many of the wanted components it gives
    different: dict[tuple, int] = defaultdict(int)
    for row in isolated:
        different[row.low, row.bits] += 1
    digits = 40 + 2 * ROOT_BITS // 3 + len(str(max(abs(v) for r in matrix for v in r)))
    whole = spark.sparkContext.broadcast(matrix)

    def vectors_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for low, bits, many in zip(*(c.to_pylist() for c in batch.columns)):
                found.append(null_vectors(whole.value, _middle(int(low), bits, digits), many, digits).T.tolist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(found, pa.list_(pa.list_(pa.float64())))], names=["low", "bits", "vectors"]
            )

    tasks = spark.createDataFrame([(*r, m) for r, m in different.items()], "low string, bits int, many int")
    solved = tasks.repartition(len(different)).mapInArrow(
        vectors_of, "low string, bits int, vectors array<array<double>>"
    )
    vectors_at = {(r.low, r.bits): r.vectors for r in solved.collect()}
    values, explained, columns = [], [], []
    trace = sum(matrix[i][i] for i in range(len(matrix)))
    with localcontext() as context:
        context.prec = digits
        for (low, bits), many in different.items():
            root = _middle(int(low), bits, digits)
            values += [float(root * common / (Decimal(n) * n))] * many
            explained += [float(root / trace)] * many
            columns += vectors_at[low, bits]
    model = Whitening(n, sums, values, explained, np.array(columns).T)
    model.identity_error = identity_error(fit, model, shift)
    return model


def _middle(low: int, bits: int, digits: int) -> Decimal:
    with localcontext() as context:
        context.prec = digits
        return Decimal(2 * low + 1) / Decimal(2) ** (bits + 1)


def identity_error(fit: DataFrame, model: Whitening, shift: int = SHIFT) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity."""
    shared = fit.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, total = shared.value, 0.0
        for batch in batches:
            y = model.project(model.centred(_rows(batch.column(0), shift)))
            y = np.hstack([y, np.ones((len(y), 1))])
            total = total + y.T @ y
        entries = np.ravel(total) if np.ndim(total) else np.empty(0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(entries), dtype=np.int32)), pa.array(entries)], names=["at", "value"]
        )

    m = len(model.eigenvalues) + 1
    flat = np.zeros(m * m)
    for row in fit.mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():
        flat[row["at"]] = row["value"]
    sums = flat.reshape(m, m) / model.n
    centre = sums[-1, :-1]
    return float(np.abs(sums[:-1, :-1] - np.outer(centre, centre) - np.eye(m - 1)).max(initial=0.0))


def whiten(
    vectors: DataFrame,
    model: Whitening,
    column: str = "embedding",
    carry: list[str] | None = None,
    scale: int = SCALE,
    shift: int = SHIFT,
) -> DataFrame:
    """The carried columns (all but the vector by default), deviation and whitened.

    ``deviation`` is the exact sum of (n * x - S)^2, null where a long does not hold it;
    ``whitened array<double>`` has an entry for each component. Rows whose vector takes
    no part are dropped; repeated rows and null ids stay. Input columns of these two
    names are replaced. ``model`` must come from vectors of the same length.
    """
    bounded_batches(vectors.sparkSession)
    wanted = [c for c in vectors.columns if c != column] if carry is None else carry
    carried = [c for c in wanted if c.lower() not in ("deviation", "whitened")]
    columns = [F.col(f"`{c}`") for c in carried]
    name = spare("x", carried)
    rows = vectors.select(*columns, whole_vector(F.col(f"`{column}`"), scale, shift).alias(name)).where(
        F.col(f"`{name}`").isNotNull()
    )
    schema = rows.select(
        *columns, F.lit(None).cast("long").alias("deviation"), F.array(F.lit(0.0)).alias("whitened")
    ).schema
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            centred = model.centred(_rows(batch.column(len(carried)), shift))
            top = int(np.abs(centred).max(initial=0))
            if centred.dtype != object and centred.shape[1] * top * top < _LONG:
                deviation = pa.array((centred * centred).sum(1))
            else:
                squares = [sum(int(v) ** 2 for v in row) for row in centred]
                deviation = pa.array([s if s < _LONG else None for s in squares], pa.int64())
            m = len(model.eigenvalues)
            flat = model.project(centred).ravel() if m else np.empty(0)
            ends = np.arange(len(centred) + 1, dtype=np.int32) * m
            whitened = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(carried)], deviation, whitened], names=[*carried, "deviation", "whitened"]
            )

    return rows.mapInArrow(run, schema)
