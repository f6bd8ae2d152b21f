"""Byte-level BPE over a table of distinct words.

Texts are split into words by Spark. Each distinct word is encoded once, by the task
that its hash names; the ids return to the chunks that hold the word and take the
places of its occurrences. Decoding looks each id's piece up and joins the bytes.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mixloom.llm.chunks import chunks
from mixloom.llm.common import bounded_batches, pack, shuffle_partitions, spare, unpack

_SPACE = r"\x09-\x0D\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
# fixed value: the word pattern of byte-level BPE, with its white space spelled out
WORDS = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
    rf"| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def special_strings(path: str) -> list[str]:
    with open(path, encoding="utf-8") as f:
        return [x["content"] for x in json.load(f)["added_tokens"]]


def split_words(text: Column, specials: list[str]) -> Column:
    """Words of a text in order; special strings are words of their own."""
    find = lambda s: F.regexp_extract_all(s, F.lit(WORDS), F.lit(0))
    text = F.coalesce(text, F.lit(""))
    if not specials:
        return find(text)
    if len(specials) > 1:
        raise ValueError("vocabularies with more than one special string are not supported")
    between = F.split(text, "\\Q" + specials[0] + "\\E")
    mark = F.array(F.lit(specials[0]))
    marked = F.flatten(
        F.transform(between, lambda s, i: F.when(i == 0, find(s)).otherwise(F.concat(mark, find(s))))
    )
    return F.when(F.instr(text, specials[0]) == 0, find(text)).otherwise(marked)


@lru_cache(maxsize=2)
def pieces(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all pieces one after another, and where each id's piece begins."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(others)}
    tokenizer = _tokenizer(path)
    special = set(special_strings(path))
    vocabulary = tokenizer.get_vocab(with_added_tokens=True)
    parts = [b""] * (max(vocabulary.values()) + 1)
    for token, ident in vocabulary.items():
        parts[ident] = token.encode() if token in special else bytes(byte_of[c] for c in token)
    starts = np.cumsum([0, *map(len, parts)])
    return np.frombuffer(b"".join(parts), np.uint8), starts


def encode(
    docs: DataFrame, tokenizer: str, text: str = "text", carry: list[str] | None = None
) -> DataFrame:
    """The carried columns (all but the text by default) and ``ids array<int>``.

    A null or empty text has no ids. ``docs`` is read twice and must give the same
    partitions both times, as files and landed tables do; a difference is noticed
    and raised.
    """
    wanted = [c for c in docs.columns if c != text] if carry is None else carry
    bounded_batches(docs.sparkSession)
    parts = shuffle_partitions(docs.sparkSession)
    key = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(wanted)])
    rows = docs.select(key.alias("key"), split_words(F.col(f"`{text}`"), special_strings(tokenizer)).alias("words"))

    def words_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, parts):
            some = np.flatnonzero(np.diff(chunk.cuts))
            offsets = np.append(chunk.cuts[some], chunk.cuts[-1])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(some.astype(np.int32)),
                    pa.array(np.full(len(some), chunk.ident)),
                    pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), chunk.words),
                ],
                names=["part", "chunk", "words"],
            )

    def encode_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _tokenizer(tokenizer)
        known: dict[str, tuple] = {}
        part = None
        for batch in batches:
            replies = []
            for row in batch.to_pylist():
                if row["part"] != part:
                    part, known = row["part"], {}
                fresh = [w for w in row["words"] if w not in known]
                for word, found in zip(fresh, coder.encode_batch_fast(fresh, add_special_tokens=False)):
                    known[word] = tuple(found.ids)
                ids = [known[w] for w in row["words"]]
                sizes = np.fromiter(map(len, ids), np.uint32, len(ids))
                flat = np.fromiter((i for x in ids for i in x), np.uint32, int(sizes.sum()))
                replies.append((row["chunk"], part, pack(sizes), pack(flat)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in replies], pa.int64()),
                    pa.array([r[1] for r in replies], pa.int32()),
                    pa.array([r[2] for r in replies], pa.binary()),
                    pa.array([r[3] for r in replies], pa.binary()),
                    pa.nulls(len(replies), key_type),
                ],
                names=["chunk", "part", "sizes", "ids", "keys"],
            )

    def places_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, parts):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([chunk.ident, chunk.ident]),
                    pa.array([-2, -1], pa.int32()),
                    pa.array([pack(np.diff(chunk.cuts).astype(np.uint32)), pack(chunk.sizes)], pa.binary()),
                    pa.array([b"", pack(chunk.codes)], pa.binary()),
                    pa.ListArray.from_arrays(pa.array([0, 0, len(chunk.keys)], pa.int32()), chunk.keys),
                ],
                names=["chunk", "part", "sizes", "ids", "keys"],
            )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                if held and held[0].column("chunk")[0] != row.column("chunk")[0]:
                    yield from _place(held, len(wanted))
                    held = []
                held.append(row)
        if held:
            yield from _place(held, len(wanted))

    from pyspark.sql.pandas.types import to_arrow_type

    source = rows.select(F.array("key").alias("keys")).schema
    schema = "chunk long, part int, sizes binary, ids binary, keys " + source[0].dataType.simpleString()
    key_type = to_arrow_type(source[0].dataType)
    asked = rows.mapInArrow(words_out, "part int, chunk long, words array<string>")
    replies = asked.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(encode_part, schema)
    both = rows.mapInArrow(places_out, schema).union(replies)
    result = docs.select(
        *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(wanted)], F.array(F.lit(0)).alias("ids")
    ).schema
    placed = both.repartition(parts, "chunk").sortWithinPartitions("chunk", "part").mapInArrow(place, result)
    return placed.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(wanted)], "ids")


def _place(rows: list, width: int) -> Iterator[pa.RecordBatch]:
    """Ids of a chunk's documents from its codes and the replies of all parts."""
    value = lambda row, name: row.column(name)[0].as_py()
    if len(rows) < 2 or [value(r, "part") for r in rows[:2]] != [-2, -1]:
        raise RuntimeError("the documents were partitioned differently when read again")
    asked, holder = rows[0], rows[1]
    expected = unpack(value(asked, "sizes"), np.uint32)
    replies = {value(r, "part"): r for r in rows[2:]}
    sizes, flat = [], []
    for part in np.flatnonzero(expected):
        reply = replies.get(int(part))
        got = unpack(value(reply, "sizes"), np.uint32) if reply is not None else []
        if len(got) != expected[part]:
            raise RuntimeError("the documents were partitioned differently when read again")
        sizes.append(got)
        flat.append(unpack(value(reply, "ids"), np.uint32))
    size = np.concatenate(sizes).astype(np.int64) if sizes else np.empty(0, np.int64)
    ids = np.concatenate(flat).astype(np.int32) if flat else np.empty(0, np.int32)
    start = np.cumsum(size) - size
    words = unpack(value(holder, "sizes"), np.int64)
    codes = unpack(value(holder, "ids"), np.uint32)
    keys = holder.column("keys").flatten()
    ends = np.cumsum(words)
    for a in range(0, len(words), 512):
        b = min(a + 512, len(words))
        own = codes[ends[a] - words[a] : ends[b - 1]]
        n = size[own]
        total = int(n.sum())
        taken = ids[np.arange(total) + np.repeat(start[own] - (np.cumsum(n) - n), n)]
        per_word = np.concatenate([[0], np.cumsum(n)])
        cuts = per_word[np.concatenate([[0], np.cumsum(words[a:b])])]
        part = keys.slice(a, b - a)
        yield pa.RecordBatch.from_arrays(
            [*part.flatten(), pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(taken))],
            names=[*[f"c{i}" for i in range(width)], "ids"],
        )


def decode(
    docs: DataFrame, tokenizer: str, ids: str = "ids", out: str = "decoded", carry: list[str] | None = None
) -> DataFrame:
    """The carried columns (all by default) and the text of the ids.

    The id-to-piece table has one row for each of the vocabulary's fixed entries, so
    each task holds it whole. Bytes that are no UTF-8 become replacement signs; null
    ids give a null text, an id without a piece raises.
    """
    wanted = [c for c in docs.columns if c != out] if carry is None else carry
    columns = [F.col(f"`{c}`") for c in wanted]
    schema = docs.select(*columns, F.lit("").alias(out)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, starts = pieces(tokenizer)
        for batch in batches:
            texts = []
            for row in batch.column(batch.num_columns - 1):
                if not row.is_valid:
                    texts.append(None)
                    continue
                own = row.values.to_numpy(zero_copy_only=False)
                if len(own) and not 0 <= own.min() <= own.max() < len(starts) - 1:
                    raise ValueError("an id has no piece")
                n = starts[own + 1] - starts[own]
                at = np.arange(int(n.sum())) + np.repeat(starts[own] - (np.cumsum(n) - n), n)
                texts.append(data[at].tobytes().decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(texts, pa.string())], names=[*wanted, out]
            )

    return docs.select(*columns, F.col(f"`{ids}`").alias(spare("_ids", wanted))).mapInArrow(run, schema)
