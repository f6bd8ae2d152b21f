"""A probabilistic suffix tree as a language model.

Contexts have none to MAX_DEPTH words. A context is retained if it predicts the words
after it better than its suffix does, by the leave-one-out estimate of
n * KL(context || suffix):
sum of n(w) * log(((n(w) - 1 + M * P(w | suffix)) / (n - 1 + M)) / P(w | suffix)).
There is no least count: a context that occurs once gains nothing by this estimate.
Distributions are smoothed with M counts of the suffix's distribution; the root's
is (c + 1) / (N + V + 1). A word is scored by the longest retained context.

A context is made longer by a word, whether it is retained or not, where this can gain
anything: no context one word longer gains more than the sum, over the words that follow
it at least twice, of n(w) * -log P(w | context). Where the words after a context are
certain or never repeat, the tree ends there; contexts two and more words longer are not
looked at then. Levels are added until none is left, MAX_DEPTH at most.

On Spark: documents are landed as chunks of word codes. What a chunk needs of the
whole corpus - counts of its words and of words after contexts, and which contexts
are retained or made longer - is asked for once per distinct item, by tasks that own a
hash part of all items, and comes back to the chunk by position. Hot items are thereby
summed within chunks before anything is shuffled, and no part grows with one item. An
item that only one chunk asked for is told so, and its longer forms stay in that chunk.
A level's open positions and items are landed from the second level on, so that no level
is gone through twice; the level before is removed. In place of probabilities, the counts
that they follow from are landed. From the third level on, this is a chunk of its own, with
those words only that contexts of open positions can reach.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mixloom.llm.chunks import Chunk, chunks, listed
from mixloom.llm.common import (
    bounded_batches, discard_buckets, land, land_by, pack, shuffle_partitions, unpack,
)
from mixloom.session import discard, landing_path

MAX_DEPTH = 8  # words of a context
CUT_LEVEL = 3  # from here on, few words are left in reach
GAIN_UNIT = 1 / 1024  # gains are summed in whole units, in any order alike
SMOOTHING = 4.0
LEAST_GAIN = 4.0
CHUNK_BYTES = 8 << 20
BATCH_BYTES = 4 << 20
_ASK = "part int, chunk long, ids binary, sums binary"
_STEP = _ASK + ", state array<binary>"
_OWN = ["sizes", "held", "codes", "ids", "counts"]
_REPLY = "chunk long, part int, data binary"


def tokens(text: pa.Array) -> pa.Array:
    """Words between ASCII white space, A-Z in lower case, and the end, which is the empty word."""
    low = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(text, "")))
    ended = pc.binary_join_element_wise(low, "", " ")
    return pc.ascii_split_whitespace(pc.if_else(pc.equal(pc.binary_length(low), 0), low, ended))


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers from 0, in four bytes each where they fit."""
    kind = np.uint32 if values.max(initial=0) < 1 << 32 else np.uint64
    return bytes([np.dtype(kind).itemsize]) + pack(values.astype(kind))


def _unpacked(data: bytes) -> np.ndarray:
    return unpack(data[1:], f"u{data[0]}").astype(np.int64)


def _mixed(*ids: np.ndarray) -> np.ndarray:
    mixed = np.full(len(ids[0]), 0x9E3779B97F4A7C15, np.uint64)
    for x in ids:
        mixed = (mixed ^ x.astype(np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)
        mixed ^= mixed >> np.uint64(33)
    return mixed


def _dealt(parts: int, ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Items in order of the parts that own them, and where each part begins."""
    part = (_mixed(*ids) % np.uint64(parts)).astype(np.uint16 if parts < 1 << 16 else np.int64)
    cuts = np.zeros(parts + 1, np.int64)
    np.cumsum(np.bincount(part, minlength=parts), out=cuts[1:])
    return np.argsort(part, kind="stable"), cuts


def _asks(chunk: int, parts: int, ids: list[np.ndarray], sums: list[np.ndarray]):
    """One row per part that owns some of the items."""
    order, cuts = _dealt(parts, ids)
    for p in np.flatnonzero(np.diff(cuts)):
        own = order[cuts[p] : cuts[p + 1]]
        yield int(p), chunk, pack(np.concatenate([x[own] for x in ids])), _packed(np.concatenate([x[own] for x in sums]))


def _ask_batches(rows: Iterator[tuple], kinds: dict[str, pa.DataType]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0

    def batch():
        columns = [pa.array(x, kind) for x, kind in zip(zip(*held), kinds.values())]
        return pa.RecordBatch.from_arrays(columns, names=list(kinds))

    for row in rows:
        held.append(row)
        size += sum(len(x) for x in (*row[2:4], *(row[4:] and row[4] or ())) if x)
        if len(held) >= 256 or size >= BATCH_BYTES:
            yield batch()
            held.clear()
            size = 0
    if held:
        yield batch()


_ASK_TYPES = {"part": pa.int32(), "chunk": pa.int64(), "ids": pa.binary(), "sums": pa.binary()}
_STEP_TYPES = _ASK_TYPES | {"state": pa.list_(pa.binary())}


def grouped(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows so that equal ones follow each other, where groups of them start in that order, each
    row's group, and whether a row is the first of its group."""
    n = len(columns[0])
    if len(columns) > 2:
        key = _mixed(*columns)
    else:
        key = columns[0].astype(np.uint64)
        for x in columns[1:]:
            key = (key << np.uint64(32)) | x
    order = np.argsort(key)
    change = _changes(columns, order)
    if len(columns) > 2 and (change[1:] != _changes([key], order)[1:]).any():  # one key of different rows
        order = np.lexsort(columns[::-1])
        change = _changes(columns, order)
    group, first = np.empty(n, np.int64), np.empty(n, bool)
    group[order], first[order] = np.cumsum(change) - 1, change
    return order, np.flatnonzero(change), group, first


def _changes(columns: list[np.ndarray], order: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before, in the given order."""
    change = np.zeros(len(order), bool)
    change[:1] = True
    for x in columns:
        ordered = x[order]
        change[1:] |= ordered[1:] != ordered[:-1]
    return change


def numbered(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of numbers below 2**31, in order, and each row's place among them."""
    a, b, c = int(first.max(initial=0)).bit_length(), int(last.max(initial=0)).bit_length(), len(first).bit_length()
    key = (first.astype(np.int64) << b) | last
    if a + b + c < 64:  # sorting numbers that hold their rows is faster than ordering rows by them
        key = (key << c) | np.arange(len(key))
        key.sort()
        order = key & ((1 << c) - 1)
        key >>= c
    else:
        order = np.argsort(key)
        key = key[order]
    change = np.ones(len(key), bool)
    change[1:] = key[1:] != key[:-1]
    place = np.empty(len(key), np.int32)
    place[order] = np.cumsum(change, dtype=np.int32) - 1
    key = key[change]
    return key >> b, key & ((1 << b) - 1), place


def _count(ids: list[np.ndarray], sums: list[np.ndarray]) -> np.ndarray:
    """Items' totals; bits: asked for by one chunk alone, and the row that owns the item."""
    order, starts, group, first = grouped(ids)
    totals = np.add.reduceat(sums[0][order], starts)
    alone = np.diff(np.append(starts, len(order))) == 1
    return (totals[group] << 2) | (alone[group] << 1) | first


def _judge(n, repeated, likely, gained) -> tuple[np.ndarray, np.ndarray]:
    """Whether contexts are retained, and whether longer ones can be, from their sums.

    ``repeated``: occurrences of following words that occur at least twice; ``likely``: their
    n(w) * log(n(w) + M * P(w | suffix)); ``gained``: over all following words, the part of
    the gain that does not hold n.
    """
    size = np.maximum(n, 1)
    gain = gained * GAIN_UNIT - n * np.log(size - 1 + SMOOTHING)
    left = repeated * np.log(size + SMOOTHING) - likely * GAIN_UNIT
    return (n > 1) & (gain >= LEAST_GAIN), (n > 1) & (left >= LEAST_GAIN)


def _retain(ids: list[np.ndarray], sums: list[np.ndarray]) -> np.ndarray:
    """Contexts' counts; bits: can be made longer, is retained."""
    order, starts, group, _ = grouped(ids)
    n, *rest = (np.add.reduceat(x[order], starts) for x in sums)
    retained, longer = _judge(n, *rest)
    return ((n << 2) | (longer << 1) | retained)[group]


def _answers(asks: DataFrame, parts: int, answer: Callable, width: int, n_sums: int) -> DataFrame:
    """Replies to all asks of a part taken together, in the order asked."""

    def close(rows: list) -> Iterator[pa.RecordBatch]:
        ids = np.concatenate([unpack(r["ids"], np.uint32).reshape(width, -1) for r in rows], axis=1)
        sums = [_unpacked(r["sums"]).reshape(n_sums, -1) for r in rows]
        values = answer(list(ids), list(np.concatenate(sums, axis=1)))
        ends = np.cumsum([x.shape[1] for x in sums])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([r["chunk"] for r in rows], pa.int64()),
                pa.array([r["part"] for r in rows], pa.int32()),
                pa.array([_packed(values[e - x.shape[1] : e]) for e, x in zip(ends, sums)], pa.binary()),
            ],
            names=["chunk", "part", "data"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and held[0]["part"] != row["part"]:
                    yield from close(held)
                    held = []
                held.append(row)
        if held:
            yield from close(held)

    return asks.repartition(parts, "part").sortWithinPartitions("part", "chunk").mapInArrow(run, _REPLY)


def _joined(chunk_table: DataFrame, **more: DataFrame) -> DataFrame:
    """Chunks with further columns of tables in the same buckets; nothing is shuffled."""
    for name, other in more.items():
        own = other.select(F.col("chunk").alias("_of"), name)
        chunk_table = chunk_table.join(own, F.col("chunk") == F.col("_of"), "left").drop("_of")
    return chunk_table


class _Chunk:
    """A chunk with global ids and counts of its words, its open level and what was replied.

    Level k holds contexts of k words, and items: a context and the word after it. Each
    level is opened from the one before.
    """

    def __init__(self, row: dict, parts: int, total: int, distinct: int, level: int):
        self.ident = row["chunk"]
        self.parts = parts
        self.level = level
        words = row["state"][:5] if level >= CUT_LEVEL else [row[x] for x in _OWN]
        self.sizes = unpack(words[0], np.int64)
        self.held = unpack(words[1], np.uint8).astype(bool)
        self.codes = unpack(words[2], np.uint32).view(np.int32)
        self.ids = unpack(words[3], np.uint32)
        self.counts = unpack(words[4], np.int64)
        self.document = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)
        self.root = (self.counts + 1) / (total + distinct + 1)
        self.replies = {name: row.get(name) or [] for name in ("items", "contexts")}
        if level > 1:
            self._load(row["state"][5 * (level >= CUT_LEVEL) :])
        else:
            # whether the words of the last level's length that end at a position occur less than twice
            self.rare = self.counts[self.codes] < 2
            self.score = self.base()
            self.trace: list[tuple[np.ndarray, np.ndarray]] = []
            self.level = 0
            if level:
                self.open_level()

    def state(self) -> list[bytes]:
        """The open level, from the third on with the words that contexts of its positions can reach."""
        at, rare = self.at, self.rare
        words = []
        if self.level >= CUT_LEVEL:
            open_, reach = np.zeros(len(self.codes), bool), np.zeros(len(self.codes), bool)
            open_[at] = True
            for k in range(min(MAX_DEPTH + 1, len(reach))):
                reach[: len(reach) - k] |= open_[k:]
            codes = self.codes[reach]
            used = np.bincount(codes, minlength=len(self.ids)) > 0
            number = (np.cumsum(used) - 1).astype(np.uint32)
            sizes = np.bincount(self.document[reach], minlength=len(self.sizes)).astype(np.int64)
            words = [sizes, self.held.astype(np.uint8), number[codes], self.ids[used], self.counts[used]]
            at, rare = (np.cumsum(reach, dtype=np.int32) - 1)[at], rare[reach]
        arrays = [
            *words, np.packbits(rare), self.score, np.diff(at, prepend=np.int32(0)), self.item,
            np.packbits(np.diff(self.context, prepend=np.int32(-1)) > 0),
            np.packbits(self.alone), np.packbits(self.context_alone),
        ]
        return [*map(pack, arrays), *(_packed(x) for pair in self.trace for x in pair)]

    def _load(self, state: list[bytes]):
        rare, self.score, steps, self.item, change, alone, context_alone = (
            unpack(x, kind) for x, kind in zip(state, "u1 f8 i4 i4 u1 u1 u1".split())
        )
        trace = [_unpacked(x) for x in state[7:]]
        self.trace = list(zip(trace[::2], trace[1::2]))
        self.rare = np.unpackbits(rare, count=len(self.codes)).astype(bool)
        self.at = np.cumsum(steps, dtype=np.int32)
        items = len(self.trace[0][0])
        self.context = np.cumsum(np.unpackbits(change, count=items), dtype=np.int32) - 1
        self.alone = np.unpackbits(alone, count=items).astype(bool)
        self.context_alone = np.unpackbits(context_alone, count=len(self.trace[0][1])).astype(bool)
        self._derive()
        self.suffix_p = self.best = self.root[self.codes[self.seen]]
        for total, judged in self.trace:
            self.suffix_p = (total + SMOOTHING * self.suffix_p) / ((judged >> 1)[self.context] + SMOOTHING)
            self.best = np.where((judged & 1).astype(bool)[self.context], self.suffix_p, self.best)

    def _derive(self):
        self.seen = np.empty(len(self.alone), np.int32)
        self.seen[self.item] = self.at  # a position of each item
        self.context_seen = np.empty(len(self.context_alone), np.int32)
        self.context_seen[self.context] = self.seen

    def _occurrences(self, wanted: np.ndarray) -> np.ndarray:
        """How often the wanted items stand in training documents here."""
        if not wanted.any():
            return np.zeros(len(wanted), np.int64)
        own = wanted[self.item] & ~self.held[self.document[self.at]]
        return np.bincount(self.item[own], minlength=len(wanted))

    def _per_document(self, at, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.document[at], x, len(self.sizes))

    def base(self) -> np.ndarray:
        return self._per_document(slice(None), np.log10(self.root)[self.codes])

    def _words(self, last: np.ndarray, words: int) -> list[np.ndarray]:
        """Ids of the so many words that end at the given positions."""
        return [self.ids[self.codes[last - k]] for k in range(words - 1, -1, -1)]

    def _replied(self, name: str, ids: list[np.ndarray]) -> np.ndarray:
        """Replies in the order of the items asked for."""
        got = self.replies[name]
        values = np.concatenate([_unpacked(x) for x in got]) if got else np.empty(0, np.int64)
        if len(values) != len(ids[0]):
            raise RuntimeError("replies do not match what a chunk asked for")
        out = np.empty(len(values), np.int64)
        out[_dealt(self.parts, ids)[0]] = values
        return out

    def open_level(self):
        """Items of the next level, where the context's suffix can be made longer."""
        k = self.level = self.level + 1
        if k == 1:
            at = np.arange(len(self.codes), dtype=np.int32)
        else:
            old = np.full(len(self.codes), -1, np.int32)
            old[self.at] = self.item
            at = self.at[self.longer[self.context[self.item]]]
        starts = np.cumsum(self.sizes) - self.sizes
        at = at[at >= (starts + k)[self.document[at]]]
        at = at[~self.rare[at - 1]]
        first, last, item = numbered(self.codes[at - k], self.codes[at] if k == 1 else old[at])
        # in order of the contexts' suffixes, too: a context's items follow each other
        change = np.ones(len(first), bool)
        change[1:] = first[1:] != first[:-1]
        if k > 1:
            suffix = self.context[last]
            change[1:] |= suffix[1:] != suffix[:-1]
        context = np.cumsum(change, dtype=np.int32) - 1
        if k == 1:
            self.suffix_p = self.best = self.root[last]
            self.alone, self.context_alone = np.zeros(len(first), bool), np.zeros(change.sum(), bool)
        else:
            suffix = suffix[change]
            self.suffix_p, self.best = self.p[last], self.best[last]
            self.trace = [(x[last], y[suffix]) for x, y in (*self.trace, (self.total, self.judged))]
            seen = np.empty(len(first), np.int32)
            seen[item] = at
            whole = old[seen - 1]  # the context's own words, if they were an item
            context_alone = self.context_alone[suffix]
            context_alone[context[(whole >= 0) & self.alone[whole]]] = True
            self.alone, self.context_alone = self.alone[last] | context_alone[context], context_alone
        self.at, self.item, self.context = at, item, context
        self._derive()

    def asked_items(self) -> tuple[np.ndarray, list[np.ndarray]]:
        some = np.flatnonzero(~self.alone)
        return some, self._words(self.seen[some], self.level + 1)

    def ask_items(self) -> Iterator[tuple]:
        some, ids = self.asked_items()
        if len(some):
            yield from _asks(self.ident, self.parts, ids, [self._occurrences(~self.alone)[some]])

    def count_items(self):
        """Take the totals of the level's items."""
        some, ids = self.asked_items()
        value = self._replied("items", ids)
        self.total, owned = self._occurrences(self.alone), np.ones(len(self.alone), bool)
        self.total[some], owned[some] = value >> 2, (value & 1).astype(bool)
        self.alone[some] = (value & 2).astype(bool)
        self.rare[1:] |= self.rare[:-1].copy()
        self.rare[self.at] |= self.total[self.item] < 2
        self.owned = owned

    def sum_up(self, wanted: np.ndarray):
        """What the wanted ones of the level's contexts need to be judged."""
        some = np.flatnonzero(self.owned & (self.total > 0) & wanted[self.context])
        n, p, context = self.total[some], self.suffix_p[some], self.context[some]
        gained = np.rint(n * np.log((n - 1 + SMOOTHING * p) / p) / GAIN_UNIT)
        likely = np.where(n > 1, np.rint(n * np.log(n + SMOOTHING * p) / GAIN_UNIT), 0)
        self.sums = [
            np.bincount(context, x, len(wanted)).astype(np.int64) for x in (n, n * (n > 1), likely, gained)
        ]

    def asked_contexts(self) -> tuple[np.ndarray, list[np.ndarray]]:
        some = np.flatnonzero(~self.context_alone)
        return some, self._words(self.context_seen[some] - 1, self.level)

    def ask_contexts(self) -> Iterator[tuple]:
        some, ids = self.asked_contexts()
        if len(some):
            yield from _asks(self.ident, self.parts, ids, [x[some] for x in self.sums])

    def judge_contexts(self):
        """Take the counts of the level's contexts and what becomes of them; score by the retained."""
        self.sum_up(self.context_alone)  # the others come with the reply
        some, ids = self.asked_contexts()
        value = self._replied("contexts", ids)
        n = self.sums[0]
        retained, self.longer = _judge(*self.sums)
        n[some] = value >> 2
        retained[some], self.longer[some] = (value & 1).astype(bool), (value & 2).astype(bool)
        self.judged = (n << 1) | retained
        self.p = (self.total + SMOOTHING * self.suffix_p) / (n[self.context] + SMOOTHING)
        some = np.flatnonzero(retained[self.context])
        gained = np.zeros(len(self.p))
        gained[some] = np.log10(self.p[some]) - np.log10(self.best[some])
        self.score += self._per_document(self.at, gained[self.item])
        self.best = np.where(retained[self.context], self.p, self.best)

    def finish(self):
        """Judge the open level and those after it, which this chunk alone knows of."""
        while self.level and len(self.at):
            self.count_items()
            self.judge_contexts()
            if self.level == MAX_DEPTH:
                break
            self.open_level()
            self.replies = {"items": [], "contexts": []}

    def known(self) -> np.ndarray:
        return self._per_document(slice(None), self.counts[self.codes] > 0).astype(np.int64)


_WORDS_TYPE = pa.struct({"part": pa.int32(), "lengths": pa.binary(), "bytes": pa.binary(), "train": pa.binary()})


def _words_by_part(c: Chunk, counts: np.ndarray) -> Iterator[dict]:
    """A chunk's words, packed for each part that owns some, with their counts in training documents."""
    lengths = pc.binary_length(c.words).to_numpy(zero_copy_only=False).astype(np.uint32)
    ends = np.append(0, np.cumsum(lengths, dtype=np.int64))
    data = memoryview(b"".join(c.words.cast(pa.binary()).to_pylist()))
    for p in np.flatnonzero(np.diff(c.cuts)):
        own = slice(c.cuts[p], c.cuts[p + 1])
        yield {
            "part": int(p), "lengths": pack(lengths[own]), "train": pack(counts[own]),
            "bytes": zstandard.ZstdCompressor(level=3).compress(data[ends[own.start] : ends[own.stop]]),
        }


def score_documents(
    docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    The model learns from rows whose ``held_out`` is not true; a null counts as
    held out. Null texts are empty: they hold the end alone. Repeated rows are
    counted and scored each. ``base_score`` is the root's log10 probability, and
    without training rows both scores are that of one unknown token each.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))  # a chunk or so at once
    parts = shuffle_partitions(spark)
    key = F.struct(
        F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(held_out, F.lit(True)).alias("held_out")
    )
    rows = docs.select(key.alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    keys_type = rows.select(F.array("key").alias("keys")).schema[0].dataType.simpleString()

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worded = (
            pa.RecordBatch.from_arrays([b.column(0), tokens(b.column(1))], names=["key", "words"]) for b in batches
        )
        for c in chunks(worded, parts, CHUNK_BYTES):
            held = pc.struct_field(c.keys, 1).to_numpy(zero_copy_only=False).astype(np.uint8)
            train = np.repeat(held == 0, c.sizes)
            counts = np.bincount(c.codes, train, len(c.words)).astype(np.uint32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([c.ident]), listed(c.keys),
                    *[pa.array([pack(x)], pa.binary()) for x in (held, c.sizes, c.codes)],
                    pa.array([list(_words_by_part(c, counts))], pa.list_(_WORDS_TYPE)),
                ],
                names=["chunk", "keys", "held", "sizes", "codes", "words"],
            )

    coded_at, words_at = landing_path(spark, "coded"), landing_path(spark, "words")
    coded = land_by(
        rows.mapInArrow(
            code,
            f"chunk long, keys {keys_type}, held binary, sizes binary, codes binary, "
            "words array<struct<part:int,lengths:binary,bytes:binary,train:binary>>",
        ),
        "chunk",
        "coded",
        coded_at,
    )
    replies = land(_word_counts(coded, parts), "words", words_at)
    sums = replies.where("chunk < 0").agg(F.sum("n"), F.sum("v")).first()
    total, distinct = int(sums[0] or 0), int(sums[1] or 0)
    resolved = _resolve(coded, replies.where("chunk >= 0"))
    discard_buckets(spark, "coded", coded_at)  # words are needed no more
    discard(spark, words_at)

    def stage(step: Callable[[_Chunk], Iterator[tuple]], level: int, kinds: dict) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def rows():
                for batch in batches:
                    for at in range(batch.num_rows):
                        yield from step(_Chunk(batch.slice(at, 1).to_pylist()[0], parts, total, distinct, level))

            yield from _ask_batches(rows(), kinds)

        return run

    def next_level(c: _Chunk) -> Iterator[tuple]:
        c.count_items()
        c.judge_contexts()
        c.replies = {}
        c.open_level()
        yield None, c.ident, None, None, c.state()
        yield from ((*ask, None) for ask in c.ask_items())

    def contexts_of(c: _Chunk) -> Iterator[tuple]:
        c.count_items()
        c.sum_up(~c.context_alone)
        yield from c.ask_contexts()

    landed: list[tuple[str, str]] = []

    def landing(df: DataFrame, label: str) -> DataFrame:
        landed.append((label, landing_path(spark, label)))
        return land_by(df, "chunk", *landed[-1], compression="uncompressed")  # packed as it is

    def answered(asks: DataFrame, name: str, level: int) -> DataFrame:
        """Replies landed as one row a chunk, in the chunks' buckets."""
        width, sums, answer = (level, 4, _retain) if name == "contexts" else (level + 1, 1, _count)
        own = _answers(asks, parts, answer, width, sums).repartition(parts, "chunk").groupBy("chunk").agg(
            F.sort_array(F.collect_list(F.struct("part", "data"))).alias("got")
        )
        return landing(own.select("chunk", F.col("got.data").alias(name)), f"{name}_{level}")

    base = whole = resolved.select("chunk", *_OWN)
    known: dict[str, DataFrame] = {}
    for level in range(1, MAX_DEPTH + 1):
        if level == 1:
            asks = base.mapInArrow(stage(_Chunk.ask_items, 1, _ASK_TYPES), _ASK)
        else:
            before = len(landed)
            step = _joined(base, **known).mapInArrow(stage(next_level, level - 1, _STEP_TYPES), _STEP)
            step = landing(step, f"level_{level}")
            for old in landed[:before]:
                discard_buckets(spark, *old)
            del landed[:before]
            base, known = step.where("part IS NULL").select("chunk", "state"), {}
            if level < CUT_LEVEL:
                base, known = whole, {"state": base}
            asks = step.where("part IS NOT NULL").select("part", "chunk", "ids", "sums")
            if asks.isEmpty():  # what is left, single chunks know by themselves
                break
        known["items"] = answered(asks, "items", level)
        asks = _joined(base, **known).mapInArrow(stage(contexts_of, level, _ASK_TYPES), _ASK)
        known["contexts"] = answered(asks, "contexts", level)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                one = batch.slice(at, 1)
                keys = one.column("keys").flatten()
                row = one.drop_columns(["keys"]).to_pylist()[0]
                c = _Chunk(row, parts, total, distinct, 0)
                n, known, base = c.sizes, c.known(), c.base()
                del c
                left = _Chunk(row, parts, total, distinct, level)
                left.finish()
                yield pa.RecordBatch.from_arrays(
                    [
                        pc.struct_field(keys, 0), pc.struct_field(keys, 1),
                        pa.array(n), pa.array(known), pa.array(np.full(len(n), total)),
                        pa.array(base), pa.array(left.score),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    schema = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), F.lit(True).alias("held_out"),
        *[F.lit(0).cast("long").alias(c) for c in ("n_tokens", "n_known", "train_tokens")],
        *[F.lit(0.0).alias(c) for c in ("base_score", "score")],
    ).schema
    if level >= CUT_LEVEL:
        known["state"] = base
    return _joined(resolved, **known).mapInArrow(score, schema)


def _word_counts(coded: DataFrame, parts: int) -> DataFrame:
    """Counts and ids of each chunk's words by part, and each part's sums (chunk -1)."""

    def close(part: int, rows: list) -> pa.RecordBatch:
        lengths = [unpack(r["lengths"], np.uint32) for r in rows]
        offsets = np.zeros(sum(map(len, lengths)) + 1, np.int64)
        np.cumsum(np.concatenate(lengths), out=offsets[1:])
        data = pa.py_buffer(b"".join(zstandard.ZstdDecompressor().decompress(r["bytes"]) for r in rows))
        words = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), data)
        coded = words.dictionary_encode()
        at = coded.indices.to_numpy(zero_copy_only=False)
        n = np.concatenate([unpack(r["train"], np.uint32) for r in rows]).astype(np.int64)
        counts = np.bincount(at, n, len(coded.dictionary)).astype(np.int64)
        rank = np.empty(len(counts), np.int64)
        rank[np.argsort(-counts, kind="stable")] = np.arange(len(counts))
        ids = rank * parts + part  # small numbers for frequent words
        if len(ids) and ids.max() >= 1 << 32:
            raise OverflowError("more than 2**32 distinct words: raise spark.sql.shuffle.partitions")
        ends = np.cumsum([len(x) for x in lengths])
        spans = [slice(e - len(x), e) for e, x in zip(ends, lengths)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([-1, *(r["chunk"] for r in rows)], pa.int64()),
                pa.array([part] * (len(rows) + 1), pa.int32()),
                pa.array([None, *(pack(counts[at[s]]) for s in spans)], pa.binary()),
                pa.array([None, *(pack(ids[at[s]].astype(np.uint32)) for s in spans)], pa.binary()),
                pa.array([int(counts.sum()), *[None] * len(rows)], pa.int64()),
                pa.array([int((counts > 0).sum()), *[None] * len(rows)], pa.int64()),
            ],
            names=["chunk", "part", "counts", "ids", "n", "v"],
        )

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and held[0]["part"] != row["part"]:
                    yield close(held[0]["part"], held)
                    held = []
                held.append(row)
        if held:
            yield close(held[0]["part"], held)

    return (
        coded.select("chunk", F.inline("words")).repartition(parts, "part").sortWithinPartitions("part", "chunk")
        .mapInArrow(answer, "chunk long, part int, counts binary, ids binary, n long, v long")
    )


def _resolve(coded: DataFrame, replies: DataFrame) -> DataFrame:
    """Chunks with ids and counts of their words, which are renumbered by frequency."""
    own = replies.groupBy(F.col("chunk").alias("of")).agg(
        F.sort_array(F.collect_list(F.struct("part", "counts", "ids"))).alias("replies")
    )
    joined = coded.select("chunk", "keys", "held", "sizes", "codes").join(own, F.col("chunk") == F.col("of"))
    schema = coded.select("chunk", "keys", "held", "sizes", "codes", F.col("codes").alias("ids"), F.col("codes").alias("counts")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                replies = row.column("replies")[0].as_py()
                counts = np.concatenate([unpack(r["counts"], np.int64) for r in replies])
                ids = np.concatenate([unpack(r["ids"], np.uint32) for r in replies])
                codes = unpack(row.column("codes")[0].as_py(), np.uint32)
                order = np.argsort(-np.bincount(codes, minlength=len(ids)), kind="stable")
                number = np.empty(len(ids), np.uint32)
                number[order] = np.arange(len(ids), dtype=np.uint32)
                blobs = [pack(number[codes]), pack(ids[order]), pack(counts[order])]
                yield pa.RecordBatch.from_arrays(
                    [*(row.column(c) for c in ("chunk", "keys", "held", "sizes")), *(pa.array([x], pa.binary()) for x in blobs)],
                    names=["chunk", "keys", "held", "sizes", "codes", "ids", "counts"],
                )

    return land_by(joined.mapInArrow(run, schema), "chunk", "resolved")
