"""NumPy helpers that run inside Arrow tasks.

Spark partitions the points; a task sees Arrow batches, packs or folds them and
emits a few rows. The module is pickled by value, so executors need no installed
copy of the package.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

BLOCK_SCHEMA = "n int, block binary"
KEYED_BLOCK_SCHEMA = "key bigint, n int, block binary"
STATS_SCHEMA = "model int, component int, term int, value double"

# rows that are put in the order of their keys at a time
KEYED_ROWS = 1 << 17

# component number of rows that belong to the whole data set
WHOLE = -1

# squared whitened distance of a mean from the middle of the means up to which densities
# and sums are taken as polynomials about the middle: at most 11 of 16 digits are lost to it
NEAR_MIDDLE = 1e5


def _columns_to_matrix(batch: pa.RecordBatch) -> np.ndarray:
    """(d, n) float64 from d numeric columns or one array column; NULL -> NaN."""
    first = batch.column(0)
    if batch.num_columns == 1 and pa.types.is_list(first.type):
        n = len(first)
        flat = first.flatten().to_numpy(zero_copy_only=False).astype("float64")
        if n == 0:
            return np.empty((0, 0))
        sizes = np.diff(first.offsets.to_numpy())
        if first.null_count or (sizes != sizes[0]).any():
            raise ValueError("feature arrays must be present and of equal length")
        return np.ascontiguousarray(flat.reshape(n, int(sizes[0])).T)
    return np.stack(
        [
            c.to_numpy(zero_copy_only=False).astype("float64")
            for c in batch.columns
        ]
    )


def _matrices(batch: pa.RecordBatch):
    """The (d, n) matrices of a batch of packed blocks or of plain points."""
    if batch.schema.names == ["n", "block"]:
        for n, block in zip(batch.column(0), batch.column(1)):
            flat = np.frombuffer(block.as_buffer(), dtype="float64")
            yield flat.reshape(-1, n.as_py())
    elif batch.num_rows:
        yield _columns_to_matrix(batch)


def pack_batches(batches):
    """Each Arrow batch of points becomes one row holding a (d, n) float64 block."""
    for batch in batches:
        if batch.num_rows:
            matrix = _columns_to_matrix(batch)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([batch.num_rows], pa.int32()),
                    pa.array([matrix.tobytes()], pa.binary()),
                ],
                names=["n", "block"],
            )


def unpack_blocks(batches):
    """Packed blocks as points again, one array of coordinates each."""
    for batch in batches:
        for matrix in _matrices(batch):
            d, n = matrix.shape
            flat = pa.array(np.ascontiguousarray(matrix.T).reshape(-1))
            offsets = pa.array(np.arange(n + 1, dtype=np.int32) * d)
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(offsets, flat)], names=["features"]
            )


def pack_keyed_batches(batches):
    """The same for rows led by a key column: a block holds one key only."""
    for batch in batches:
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        rest = pa.RecordBatch.from_arrays(batch.columns[1:], names=batch.schema.names[1:])
        cuts = np.flatnonzero(np.diff(keys)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(keys)]):
            if hi > lo:
                matrix = _columns_to_matrix(rest.slice(lo, hi - lo))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([keys[lo]], pa.int64()),
                        pa.array([hi - lo], pa.int32()),
                        pa.array([matrix.tobytes()], pa.binary()),
                    ],
                    names=["key", "n", "block"],
                )


def pack_keyed_runs(first: int, last: int):
    """Task function: the same for keys in any order, of which ``first .. last - 1`` are taken.

    Some batches are packed at a time, so that blocks are not small.
    """

    def pack(batches):
        held, rows = [], 0
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            own = (keys >= first) & (keys < last)
            if not own.all():
                batch = batch.filter(pa.array(own))
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= KEYED_ROWS:
                yield _keyed_blocks(held)
                held, rows = [], 0
        if held:
            yield _keyed_blocks(held)

    return pack


def _keyed_blocks(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    keys = np.concatenate([b.column(0).to_numpy(zero_copy_only=False) for b in held])
    names = held[0].schema.names[1:]
    matrix = np.hstack(
        [_columns_to_matrix(pa.RecordBatch.from_arrays(b.columns[1:], names=names)) for b in held]
    )
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1), len(keys)]
    blocks = [matrix[:, order[lo:hi]].tobytes() for lo, hi in zip(cuts, cuts[1:])]
    return pa.RecordBatch.from_arrays(
        [pa.array(keys[cuts[:-1]], pa.int64()), pa.array(np.diff(cuts), pa.int32()), pa.array(blocks, pa.binary())],
        names=["key", "n", "block"],
    )


def by_key(batches):
    """(key, (d, n) matrix) from packed blocks that come in the order of their keys."""
    key, parts = None, []
    for batch in batches:
        rest = pa.RecordBatch.from_arrays(batch.columns[1:], names=["n", "block"])
        for own, matrix in zip(batch.column(0).to_pylist(), _matrices(rest)):
            if own != key and parts:
                yield key, np.hstack(parts)
                parts = []
            key = own
            parts.append(matrix)
    if parts:
        yield key, np.hstack(parts)


def nest_batches(per_list: int):
    """Task function: rows led by a split -> ``(split, list of the other columns)``.

    A list holds at most ``per_list`` rows of one batch, so nothing is shuffled.
    """

    def nest(batches):
        for batch in batches:
            names = batch.schema.names[1:]
            for split in batch.column(0).unique():
                own = batch.filter(pc.equal(batch.column(0), split))
                for lo in range(0, own.num_rows, per_list):
                    part = own.slice(lo, per_list)
                    rows = pa.StructArray.from_arrays(part.columns[1:], names=names)
                    offsets = pa.array([0, len(rows)], pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([split.as_py()]), pa.ListArray.from_arrays(offsets, rows)],
                        names=["split", "rows"],
                    )

    return nest


def _sum_of_logs(x: np.ndarray) -> float:
    """Sum of the logs of numbers from 1 to K, of 32 of them at a time by their product."""
    whole = len(x) // 32 * 32
    return float(np.log(x[:whole].reshape(32, -1).prod(axis=0)).sum() + np.log(x[whole:]).sum())


class Fold:
    """Sums of points per component of one model.

    For each component the sums of r, r*z and r*z*z' are kept, z being the point
    whitened by that component. ``hard`` gives each point to its most likely
    component (lowest number on ties) instead of sharing it out.

    In few dimensions a log density is a polynomial in the coordinates about the middle of
    the means: all of them, and all sums, are one matrix product each with the monomials,
    and ``table`` brings the sums to the components' own means and axes. Means too far
    from the middle for that, many dimensions and ``hard`` go point by whitened point.
    """

    def __init__(self, whiten: np.ndarray, means: np.ndarray, constant: np.ndarray, hard: bool):
        self.k, self.d = k, d = means.shape
        self.flat = whiten.reshape(k * d, d)
        self.constant, self.hard = constant, hard
        # distances are taken from the middle of the means, so that data far from zero
        # lose no digits
        self.middle = means.mean(axis=0)
        self.shift = np.einsum("kij,kj->ki", whiten, means - self.middle).reshape(k * d, 1)
        # points per slice, so that the temporaries of a slice stay in cache
        self.step = max(256, (1 << 15) // (k * d))
        self.weight = np.zeros(k)
        self.first = np.zeros((k, d))
        self.second = np.zeros((k, d, d))
        self.total = 0.0
        self.count = 0
        self.upper = np.triu_indices(d)
        self.monomials = not hard and d <= 4 and float((self.shift**2).reshape(k, d).sum(axis=1).max()) <= NEAR_MIDDLE
        if self.monomials:
            self.whiten, self.offset = whiten, means - self.middle
            i, j = self.upper
            own = self.shift.reshape(k, d)
            precision = np.einsum("kij,kil->kjl", whiten, whiten)[:, i, j]
            self.terms = np.concatenate(
                [
                    (constant - 0.5 * (own**2).sum(axis=1))[:, None],
                    np.einsum("kij,ki->kj", whiten, own),
                    np.where(i == j, -0.5, -1.0) * precision,
                ],
                axis=1,
            )
            self.sums = np.zeros_like(self.terms)
            self.step = max(256, (1 << 17) // sum(self.terms.shape))

    def _whitened(self, x):
        if self.d > 4:
            z = self.flat @ x
        else:  # plain products beat a matrix product this thin
            z = self.flat[:, :1] * x[0]
            for axis in range(1, self.d):
                z += self.flat[:, axis : axis + 1] * x[axis]
        z -= self.shift
        return z.reshape(self.k, self.d, -1)

    def add(self, x: np.ndarray) -> None:
        """Add the points of a (d, n) matrix."""
        if x.shape[0] != self.d:
            raise ValueError(f"points have {x.shape[0]} dimensions, the model has {self.d}")
        if self.monomials:
            return self._add_monomials(x)
        for lo in range(0, x.shape[1], self.step):
            part = x[:, lo : lo + self.step] - self.middle[:, None]
            z = self._whitened(part)
            score = self.constant[:, None] - 0.5 * np.einsum("kdn,kdn->kn", z, z)
            top = score.max(axis=0)
            if self.hard:
                share = np.zeros_like(score)
                share[score.argmax(axis=0), np.arange(score.shape[1])] = 1.0
                self.total += float(top.sum())
            else:
                share = np.exp(score - top)
                norm = share.sum(axis=0)
                share /= norm
                self.total += float((top + np.log(norm)).sum())
            weighted = z * share[:, None, :]
            self.weight += share.sum(axis=1)
            self.first += weighted.sum(axis=2)
            self.second += weighted @ z.transpose(0, 2, 1)
            self.count += part.shape[1]

    def _add_monomials(self, x: np.ndarray) -> None:
        for lo in range(0, x.shape[1], self.step):
            part = x[:, lo : lo + self.step]
            n = part.shape[1]
            powers = np.empty((self.terms.shape[1], n))
            powers[0] = 1.0
            np.subtract(part, self.middle[:, None], out=powers[1 : 1 + self.d])
            for own, i, j in zip(powers[1 + self.d :], *self.upper):
                np.multiply(powers[1 + i], powers[1 + j], out=own)
            share = self.terms @ powers
            top = share.max(axis=0)
            share -= top
            np.exp(share, out=share)
            norm = share.sum(axis=0)
            share /= norm
            self.total += float(top.sum()) + _sum_of_logs(norm)
            self.sums += share @ powers.T
            self.count += n

    def _from_monomials(self) -> None:
        """The sums about the middle as sums about each mean, whitened."""
        self.weight = self.sums[:, 0]
        about = self.sums[:, 1 : 1 + self.d]
        second = np.empty((self.k, self.d, self.d))
        i, j = self.upper
        second[:, i, j] = second[:, j, i] = self.sums[:, 1 + self.d :]
        first = about - self.weight[:, None] * self.offset
        # sum r (x - o)(x - o)' = sum r x x' - (sum r x) o' - o (sum r (x - o))'
        second -= about[:, :, None] * self.offset[:, None, :] + self.offset[:, :, None] * first[:, None, :]
        self.first = np.einsum("kij,kj->ki", self.whiten, first)
        self.second = self.whiten @ second @ self.whiten.transpose(0, 2, 1)

    def table(self) -> np.ndarray:
        """(K, 1 + d + d(d+1)/2): a row of sums for each component."""
        if self.monomials:
            self._from_monomials()
        upper = self.upper
        return np.concatenate(
            [self.weight[:, None], self.first, self.second[:, upper[0], upper[1]]], axis=1
        )


def fold_blocks(models: list[tuple]):
    """Task function: packed blocks or points -> the partition's sums of every model.

    ``models`` holds the arguments of a ``Fold`` each; one pass serves them all.
    """

    def fold(batches):
        folds = [Fold(*m) for m in models]
        for batch in batches:
            for x in _matrices(batch):
                for f in folds:
                    f.add(x)
        for number, f in enumerate(folds):
            if not f.count:
                return
            table = f.table()
            k, terms = table.shape
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(k * terms + 2, number), pa.int32()),
                    pa.array(np.concatenate([np.repeat(np.arange(k), terms), [WHOLE, WHOLE]]), pa.int32()),
                    pa.array(np.concatenate([np.tile(np.arange(terms), k), [0, 1]]), pa.int32()),
                    pa.array(np.concatenate([table.ravel(), [f.total, f.count]])),
                ],
                names=["model", "component", "term", "value"],
            )

    return fold


def _mixed(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit words (multiplications wrap around)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _distinct_points(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct columns of a (d, n) matrix by their 64-bit hash, how often each stands
    there, and the hashes."""
    x = x + 0.0  # one zero only
    mark = np.zeros(x.shape[1], np.uint64)
    for axis in x:
        mark = _mixed(mark + np.uint64(0x9E3779B97F4A7C15) + np.ascontiguousarray(axis).view(np.uint64))
    mark, first, copies = np.unique(mark, return_index=True, return_counts=True)
    return x[:, first], copies, mark


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centre of each column and the squared distance to it."""
    label, square = np.empty(x.shape[1], np.int64), np.empty(x.shape[1])
    step = max(256, (1 << 15) // len(centres))
    for lo in range(0, x.shape[1], step):
        all_squares = np.zeros((len(centres), min(step, x.shape[1] - lo)))
        for axis, places in zip(x, centres.T):
            gap = axis[lo : lo + step] - places[:, None]
            gap *= gap
            all_squares += gap
        label[lo : lo + step] = all_squares.argmin(axis=0)
        square[lo : lo + step] = all_squares.min(axis=0)
    return label, square


RACE_SCHEMA = "draw int, time double, point array<double>"
# draw number of the row of a task that met a NULL or NaN coordinate
BAD = -1


def race_blocks(draws: list[tuple]):
    """Task function: for each ``(seed, centres or None, most)`` the winners of a race.

    A point runs at a rate of its squared distance to the nearest centre (1 without
    centres), copies of it add up: those first in are a draw without replacement by these
    weights. A task keeps its first ``most`` points; the first of all tasks are among them.
    Times come from a hash of the point, its block and the seed, so a task that is run
    again over the same blocks has the same winners.
    """

    def run(batches):
        best = [(np.empty(0), None)] * len(draws)
        for batch in batches:
            for x in _matrices(batch):
                if not np.isfinite(x).all():
                    yield _race_rows([BAD], [0.0], [[]])
                    return
                points, copies, mark = _distinct_points(x)
                salt = np.bitwise_xor.reduce(_mixed(mark + copies.astype(np.uint64)))
                for number, (seed, centres, most) in enumerate(draws):
                    rate = copies.astype(float)
                    if centres is not None:
                        rate = rate * _nearest(points, centres)[1]
                    word = _mixed(_mixed(mark ^ salt) + np.uint64(seed & (1 << 64) - 1))
                    uniform = ((word >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)
                    runs = rate > 0
                    times, own = -np.log(uniform[runs]) / rate[runs], points[:, runs]
                    if len(times) > most:
                        ahead = np.argpartition(times, most - 1)[:most]
                        times, own = times[ahead], own[:, ahead]
                    held = best[number][1]
                    times = np.concatenate([best[number][0], times])
                    own = own if held is None else np.hstack([held, own])
                    order = np.argsort(times, kind="stable")
                    # a point that ran in several blocks counts with its first time
                    order = order[np.sort(np.unique(own[:, order].T, axis=0, return_index=True)[1])][:most]
                    best[number] = times[order], own[:, order]
        for number, (times, own) in enumerate(best):
            if len(times):
                yield _race_rows([number] * len(times), times, own.T.tolist())

    return run


def _race_rows(draw, time, point) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(draw, pa.int32()), pa.array(time, pa.float64()), pa.array(point, pa.list_(pa.float64()))],
        names=["draw", "time", "point"],
    )


def count_nearest(sets: list[np.ndarray]):
    """Task function: for each set of centres, how many points are nearest to each."""

    def run(batches):
        counts = [np.zeros(len(c), np.int64) for c in sets]
        for batch in batches:
            for x in _matrices(batch):
                for centres, count in zip(sets, counts):
                    count += np.bincount(_nearest(x, centres)[0], minlength=len(centres))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([np.full(len(c), i) for i, c in enumerate(counts)]), pa.int32()),
                pa.array(np.concatenate([np.arange(len(c)) for c in counts]), pa.int32()),
                pa.array(np.concatenate(counts), pa.int64()),
            ],
            names=["draw", "centre", "n"],
        )

    return run


cloudpickle.register_pickle_by_value(sys.modules[__name__])
