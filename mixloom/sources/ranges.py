"""Text files read in byte ranges by many tasks, where order and nesting matter.

Spark's text source cuts a file into byte ranges at any separator, so a JSON document on
one line comes apart at its braces or commas and every task reads its own range. What a
range means depends on what stands before it: how many lines, whether it begins inside a
string, how deep, under which key. The quotes of each range, counted by Spark, tell which
ranges begin inside a string; then each range says what it does to such a state. Both
times one row a range goes to the driver, which runs through them in order; a last pass
then knows where each range begins.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_QUOTE, _BACKSLASH, _COLON = b'"\\:'
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\r\n")] = True
_MARKS = _SPACE.copy()  # what cannot be part of a number
_MARKS[list(b"[]{},:")] = True
_STEP = np.zeros(256, np.int8)
_STEP[list(b"{[")] = 1
_STEP[list(b"}]")] = -1


def ranged_text(spark: SparkSession, path: str, separator: str = "\n") -> DataFrame:
    """(path, block, value): the text between separators, in order within each range."""
    source = spark.read.option("lineSep", separator).text(path)
    return source.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value"
    )


def _in_order(row) -> tuple:
    """Files by their names, numbers in them as numbers, and ranges by their begin."""
    return [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", row.path)], row.block


def numbered_lines(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """(line, value) of the lines of all files in the order of their names, and how many.

    Numbers count from 0 and do not depend on how files are cut: lines are counted for
    each byte range, the sums before a range come from one row a range, and a line adds
    its place in the range. Should ranges be cut in another way when the frame is read
    than when they were counted, reading raises.
    """
    lines = ranged_text(spark, path).withColumn("_id", F.monotonically_increasing_id())
    counts = lines.groupBy("path", "block").agg(F.count(F.lit(1)).alias("n"), F.min("_id").alias("first")).collect()
    before, rows = 0, []
    for r in sorted(counts, key=_in_order):
        rows.append((r.path, r.block, before - r.first))
        before += r.n
    shifts = spark.createDataFrame(rows, "path string, block long, shift long")  # one row a range
    changed = F.raise_error(F.lit("byte ranges were cut in another way than when lines were counted")).cast("long")
    numbered = lines.join(F.broadcast(shifts), ["path", "block"], "left").select(
        F.coalesce(F.col("_id") + F.col("shift"), changed).alias("line"), "value"
    )
    return numbered, before


@dataclass
class State:
    """Where a reader stands. For a range whose begin is not known, depth is relative."""

    inside: bool = False  # of a string
    text: bytes = b""  # of that string so far
    cut: bool = False  # that string began before what this state has seen
    depth: int = 0
    lowest: int = 0  # depth on the way
    keys: dict[int, tuple[bool, bytes]] = field(default_factory=dict)  # the last key, by depth
    values: int = 0  # numbers since the last key


@dataclass
class Walk:
    """What a stretch of bytes holds outside of strings, beginning at a state."""

    data: bytes
    outside: np.ndarray  # of strings, for each byte
    depth: np.ndarray  # after each byte
    opens: np.ndarray  # where brackets open
    closes: np.ndarray
    keys: list[tuple[int, int, bytes, bool]]  # (end, depth, text, cut) down to depth 1


def walk(data: bytes, state: State, last_keys: bool = False) -> tuple[Walk, State]:
    """Follow ``data`` from ``state``; ``last_keys`` keeps but the last key of each depth."""
    b = np.frombuffer(data, np.uint8)
    at = np.arange(len(b))
    quote = b == _QUOTE
    slash = b == _BACKSLASH
    if slash.any():  # a quote after an odd number of backslashes is text
        plain = np.maximum.accumulate(np.where(slash, -1, at))
        run = np.zeros(len(b), np.int64)
        run[1:] = at[:-1] - plain[:-1]
        quote &= run % 2 == 0
    count = np.cumsum(quote) + state.inside
    outside = (count % 2 == 0) & ~quote
    step = np.where(outside, _STEP[b], 0)
    depth = state.depth + np.cumsum(step)
    closing = np.flatnonzero(quote & (count % 2 == 0))
    opening = np.flatnonzero(quote & (count % 2 == 1))
    # strings that end here: their begin, or -1 if that lies before
    begins = opening[: len(closing)] if not state.inside else np.append(-1, opening)[: len(closing)]
    low = np.flatnonzero(depth[closing] <= 1)
    solid = np.flatnonzero(outside & ~_SPACE[b])  # what follows a string
    after = np.searchsorted(solid, closing[low])
    known = after < len(solid)
    low, after = low[known], after[known]
    low = low[b[solid[after]] == _COLON]
    if last_keys:
        _, back = np.unique(depth[closing[low]][::-1], return_index=True)
        low = np.sort(low[::-1][back])
    keys = []
    for k in low:
        begin, end = int(begins[k]), int(closing[k])
        text = data[begin + 1 : end]
        keys.append((end, int(depth[end]), state.text + text if begin < 0 else text, begin < 0 and state.cut))
    new = replace(state, keys=dict(state.keys), inside=bool((count[-1] if len(b) else state.inside) % 2))
    for _, d, text, cut in keys:
        new.keys[d] = (cut, text)
    if new.inside:
        if len(opening):
            new.text, new.cut = data[int(opening[-1]) + 1 :], False
        else:
            new.text = state.text + data
    else:
        new.text, new.cut = b"", False
    if len(b):
        new.depth = int(depth[-1])
        new.lowest = min(state.lowest, int(depth.min()))
    return Walk(data, outside, depth, np.flatnonzero(step > 0), np.flatnonzero(step < 0), keys), new


def _stretches(batch: pa.RecordBatch, separator: bytes) -> Iterator[tuple[int, bytes]]:
    """Runs of rows of the same range: its mark, and the text with separators between rows."""
    mark, value = batch.column(0).to_numpy(), batch.column(1).cast(pa.binary())
    cuts = [0, *(np.flatnonzero(np.diff(mark)) + 1).tolist(), len(mark)]
    for lo, hi in zip(cuts, cuts[1:]):
        if hi > lo:
            rows = pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), value.slice(lo, hi - lo))
            yield int(mark[lo]), pc.binary_join(rows, separator)[0].as_py()


def _marked(lines: DataFrame) -> DataFrame:
    """(mark, value): a number for each range in place of its path, which is long."""
    return lines.select(F.xxhash64("path", "block").alias("mark"), "value")


@dataclass
class Range:
    """A byte range: its place among all, and where a reader stands at its begin."""

    number: int
    first: bool  # of its file
    inside: bool  # of a string
    state: State | None = None
    opened: int = -1  # number of the range in which the open element began
    turns: bool = False  # a key at the top stands in it


def _begins(lines: DataFrame, joined: bool) -> dict[int, tuple[Range, str]]:
    """Ranges in order, by their marks, with their paths: which of them begin inside a string."""
    plain = F.when(F.contains("value", F.lit("\\")), F.regexp_replace("value", r"(?s)\\.", "")).otherwise(F.col("value"))
    quotes = F.when(
        F.contains("value", F.lit('"')), F.length(plain) - F.length(F.replace(plain, F.lit('"'), F.lit("")))
    ).otherwise(0)
    found = (
        lines.select(F.xxhash64("path", "block").alias("mark"), "path", "block", quotes.alias("quotes"))
        .groupBy("mark")
        .agg(
            F.min("block").alias("block"), F.max("block").alias("last"), F.any_value("path").alias("path"),
            F.sum("quotes").alias("quotes"),
        )
        .collect()  # one row a range
    )
    out: dict[int, tuple[Range, str]] = {}
    inside, before = False, None
    for number, row in enumerate(sorted(found, key=_in_order)):
        if row.block != row.last:
            raise RuntimeError("two byte ranges have the same mark")
        if before not in (None, row.path) and not joined:
            _check_end(State(inside), before)
            inside = False
        before = row.path
        out[row.mark] = Range(number, row.block == 0, inside), row.path
        inside ^= bool(row.quotes % 2)
    if before is not None:
        _check_end(State(inside), before)
    return out


def _begun(range_: Range, data: bytes, separator: bytes, fresh: bool) -> bytes:
    """The bytes of a stretch: a separator stands before each row but a file's first."""
    return data if fresh and range_.first else separator + data


def range_states(
    lines: DataFrame, separator: str, joined: bool, count: Callable[[Walk, State, State], None] | None = None
) -> dict[int, Range]:
    """The ranges by their marks, each with the state at its begin.

    Without ``joined`` every file begins anew and must end outside of everything; with it
    the files, in the order of their names, are parts of one text. ``count`` may add to
    the state what a walk has seen. Of text, only strings that lie across the end of a
    range and the last key of each depth reach the driver.
    """
    sep = separator.encode()
    begins = _begins(lines, joined)
    known = lines.sparkSession.sparkContext.broadcast({m: r for m, (r, _) in begins.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # in practice a task has one range, or a few small files one after the other
        ways: dict[int, State] = {}
        for batch in batches:
            for mark, text in _stretches(batch, sep):
                own, state = _range(known.value, mark), ways.get(mark)
                data = _begun(own, text, sep, state is None)
                ways[mark] = _advance(data, state or State(inside=own.inside, cut=own.inside), count)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(list(ways), pa.int64()),
                pa.array([json.dumps(_packed(s)) for s in ways.values()], pa.string()),
            ],
            names=["mark", "way"],
        )

    found = dict(map(tuple, _marked(lines).mapInArrow(run, "mark long, way string").collect()))  # one row a range
    if found.keys() != begins.keys():
        raise RuntimeError(_CHANGED)
    out: dict[int, Range] = {}
    state, opened, last = State(), -1, None
    for mark, (own, path) in begins.items():
        if last not in (None, path) and not joined:
            _check_end(state, last)
            state = State()
        last = path
        after = _unpacked(json.loads(found[mark]))
        out[mark] = replace(own, state=state, opened=opened, turns=1 - state.depth in after.keys)
        if state.depth + after.lowest <= 2:
            opened = own.number  # whatever is open at the end has begun here
        state = _composed(state, after)
    if last is not None:
        _check_end(state, last)
    return out


_CHANGED = "byte ranges were cut in another way than on the first pass"


def _range(ranges: dict[int, Range], mark: int) -> Range:
    if mark not in ranges:
        raise RuntimeError(_CHANGED)
    return ranges[mark]


def _advance(data: bytes, state: State, count) -> State:
    seen, new = walk(data, state, last_keys=True)
    if count is not None:
        count(seen, state, new)
    return new


def _check_end(state: State, path: str) -> None:
    if state.inside or state.depth:
        raise ValueError(f"the text does not end where its brackets close: {path}")


def _composed(state: State, after: State) -> State:
    """The state behind a range that does ``after``, begun at ``state``."""
    new = State(after.inside, after.text, False, state.depth + after.depth, 0, {}, after.values)
    if after.cut:  # still the string that was open before
        new.text, new.cut = state.text + after.text, state.cut
    at_top = after.keys.get(1 - state.depth)
    if at_top is not None:
        cut, text = at_top
        new.keys[1] = (False, state.text + text if cut else text)
    else:
        new.keys = {1: state.keys[1]} if 1 in state.keys else {}
        new.values += state.values
    return new


def _packed(s: State) -> list:
    keys = [[d, cut, text.decode("latin-1")] for d, (cut, text) in s.keys.items()]
    return [s.inside, s.text.decode("latin-1"), s.cut, s.depth, s.lowest, keys, s.values]


def _unpacked(row: list) -> State:
    keys = {d: (cut, text.encode("latin-1")) for d, cut, text in row[5]}
    return State(row[0], row[1].encode("latin-1"), row[2], row[3], row[4], keys, row[6])


def _name(state: State) -> str | None:
    return json.loads(b'"' + state.keys[1][1] + b'"') if 1 in state.keys else None


def read_elements(spark: SparkSession, path: str, keys: list[str], joined: bool = False) -> DataFrame:
    """(key, value): the objects in the arrays that stand under ``keys`` at the top, as JSON text.

    ``path`` is a file, a folder or a glob; a file holds one document, or several one after
    another, on one line or many. ``joined`` takes the files, in the order of their names,
    as parts of one document. Tasks read byte ranges; only an object that lies across the
    end of a range, because it holds objects itself, is shuffled to be put together.
    Elements that are numbers, strings or null are left out; a document that does not
    close raises.
    """
    lines = ranged_text(spark, path, "{")
    return _elements_under(lines, range_states(lines, "{", joined), keys)


def read_arrays(spark: SparkSession, path: str, keys: list[str], joined: bool = False) -> list[DataFrame]:
    """(value) for each of ``keys``, as ``read_elements``; the states are found once, and a
    key's elements are looked for only in the ranges that can hold some."""
    lines = ranged_text(spark, path, "{")
    states = range_states(lines, "{", joined)
    return [_elements_under(lines, states, [key]).select("value") for key in keys]


def _elements_under(lines: DataFrame, ranges: dict[int, Range], keys: list[str]) -> DataFrame:
    wanted = set(keys)
    held = [mark for mark, r in ranges.items() if r.turns or _name(r.state) in wanted]
    lines = _marked(lines)
    if len(held) < len(ranges):
        lines = lines.where(F.col("mark").isin(held))
    states = lines.sparkSession.sparkContext.broadcast(ranges)  # one entry a range

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here: int | None = None
        number, state, opened, held = 0, State(), -1, []
        for batch in batches:
            out: list[tuple] = []
            for mark, text in _stretches(batch, b"{"):
                fresh = mark != here
                own = _range(states.value, mark)
                if fresh:
                    if here is not None and held:
                        out.append((_name(state), b"".join(held), opened, number))
                    here, held = mark, []
                    number, state, opened = own.number, own.state, own.opened
                data = _begun(own, text, b"{", fresh)
                seen, new = walk(data, state)
                begins = seen.opens[(seen.depth[seen.opens] == 3)]
                ends = seen.closes[(seen.depth[seen.closes] == 2)] + 1
                marks = np.array([end for end, depth, *_ in seen.keys if depth == 1], np.int64)
                names = [json.loads(b'"' + text + b'"') for _, depth, text, _ in seen.keys if depth == 1]
                names = [_name(state), *names]
                if state.depth >= 3:  # goes on with the element that is open
                    end = int(ends[0]) if len(ends) else len(data)
                    held.append(data[:end])
                    if len(ends):
                        out.append((names[0], b"".join(held), -1 if opened == number else opened, number))
                        held, ends = [], ends[1:]
                which = np.searchsorted(marks, begins)
                for a, z, k in zip(begins.tolist(), ends.tolist(), which.tolist()):
                    if names[k] in wanted:
                        out.append((names[k], data[a:z], -1, number))
                if len(begins) > len(ends):
                    held, opened = [data[begins[-1] :]], number
                state = new
            yield _elements(out, wanted)
        if held:
            yield _elements([(_name(state), b"".join(held), opened, number)], wanted)

    pieces = lines.mapInArrow(run, "key string, value string, opened long, part long")
    whole = pieces.where("opened < 0").select("key", "value")
    across = pieces.where("opened >= 0").groupBy("key", "opened").agg(
        F.sort_array(F.collect_list(F.struct("part", "value"))).alias("parts")
    )
    return whole.union(across.select("key", F.array_join("parts.value", "").alias("value")))


def _elements(rows: list[tuple], wanted: set[str]) -> pa.RecordBatch:
    rows = [r for r in rows if r[0] in wanted]
    columns = list(zip(*rows)) or [()] * 4
    kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
    values = [columns[0], [v.decode() for v in columns[1]], *columns[2:]]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(values, kinds)], names=["key", "value", "opened", "part"]
    )


def read_lists(spark: SparkSession, path: str, joined: bool = False) -> DataFrame:
    """(key, pos, value): the numbers of a document ``{key: [number, ..], ..}``, as text.

    Files as in ``read_elements``; a range is cut at commas, so that a single list is
    read by many tasks. Parts of a joined text must be cut between numbers. Positions
    count from 0 in each list; empty lists give no rows.
    """
    lines = ranged_text(spark, path, ",")
    states = spark.sparkContext.broadcast(range_states(lines, ",", joined, _count_values))  # one entry a range

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here: int | None = None
        state = State()
        for batch in batches:
            for mark, text in _stretches(batch, b","):
                fresh = mark != here
                own = _range(states.value, mark)
                if fresh:
                    here, state = mark, own.state
                data = _begun(own, text, b",", fresh)
                seen, new = walk(data, state)
                _count_values(seen, state, new)
                begins, ends = _numbers(seen)
                listed = seen.depth[begins] == 2
                begins, ends = begins[listed], ends[listed]
                marks = np.array([end for end, depth, *_ in seen.keys if depth == 1], np.int64)
                keys = [json.loads(b'"' + t + b'"') for _, depth, t, _ in seen.keys if depth == 1]
                keys = [_name(state), *keys]
                which = np.searchsorted(marks, begins)
                first = np.searchsorted(which, np.arange(len(keys)))
                pos = np.arange(len(begins)) - first[which] + np.where(which == 0, state.values, 0)
                state = new
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.string()).take(pa.array(which)), pa.array(pos, pa.int64()), _cut(data, begins, ends)],
                    names=["key", "pos", "value"],
                )

    return _marked(lines).mapInArrow(run, "key string, pos long, value string")


def _cut(data: bytes, begins: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The texts between ``begins`` and ``ends``, which do not overlap."""
    turns = np.zeros(len(data) + 1, np.int8)
    turns[begins] = 1
    turns[ends] -= 1
    text = np.frombuffer(data, np.uint8)[np.cumsum(turns[:-1], dtype=np.int8).astype(bool)]
    offsets = np.concatenate([[0], np.cumsum(ends - begins)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(begins), pa.py_buffer(offsets), pa.py_buffer(text.tobytes()))


def _numbers(seen: Walk) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the runs of bytes outside of strings that are no marks.

    Cuts are at commas, so no number is cut itself.
    """
    held = np.zeros(len(seen.data) + 2, np.int8)
    held[1:-1] = seen.outside & ~_MARKS[np.frombuffer(seen.data, np.uint8)]
    turns = np.diff(held)
    return np.flatnonzero(turns > 0), np.flatnonzero(turns < 0)


def _count_values(seen: Walk, state: State, new: State) -> None:
    """Numbers since the last key."""
    begins, _ = _numbers(seen)
    last = max((end for end, *_ in seen.keys), default=-1)
    new.values = int((begins > last).sum()) + (state.values if last < 0 else 0)


# executors need no installed copy
cloudpickle.register_pickle_by_value(sys.modules[__name__])
