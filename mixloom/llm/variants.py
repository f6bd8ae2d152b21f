"""Spelling variants by exact signatures of letter multisets.

Two words that differ by one inserted, deleted or replaced letter have letter multisets
that differ in at most two places. A multiset is a binary vector with one dimension for
each letter and how often it has come before; dimensions are dealt into first-level parts
and each of these into second-level parts. Vectors within distance two agree, in some
first-level part, on all but a few second-level parts, so the contents of all large
enough choices of second-level parts are signatures: near words share at least one.
Words meet by an equi-join on signatures (and lengths, which differ by one at most)
and are verified in the join itself, so that only near pairs come out of it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mixloom.llm.common import bounded_batches, land

#: First- and second-level parts, for words as long (distance 2) and one longer (distance 1).
#: One first-level part met the fewest candidates: 48 million for 181,000 words with 15
#: signatures a word, against 386 million with two parts and 8 signatures.
LEVEL = (1, 6)
ONE_LONGER = (1, 4)
MIN_LETTERS = 6
MIN_COUNT = 5
MIN_RATIO = 5
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# fixed value: the letters that words are made of
LETTERS = "A-Za-zÀ-ÿ"


def lowered(run: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    ascii_only = F.length(run) == F.octet_length(run)
    return F.when(ascii_only, F.lower(run)).otherwise(F.translate(run, _UPPER, _UPPER.lower()))


def count_words(
    docs: DataFrame,
    text: str = "text",
    spoil: Column | None = None,
    every: int = 199,
    min_letters: int = MIN_LETTERS,
    min_count: int = MIN_COUNT,
) -> DataFrame:
    """(word, n) of the words of whole texts that are long and frequent enough.

    Words are maximal runs of letters, A-Z in lower case. With ``spoil``, an id column,
    a run loses the letter number h % length wherever ``every`` divides h, the crc32 of
    "id:run"; a null id counts as empty there. Null and empty texts have no words.
    Counts are combined before they are shuffled, so a frequent word is no hot key.
    """
    # a run that is too short stays so: runs only ever lose letters
    found = F.explode(F.regexp_extract_all(F.col(f"`{text}`"), F.lit(f"[{LETTERS}]{{{min_letters},}}"), F.lit(0)))
    ident = F.lit("") if spoil is None else F.coalesce(spoil.cast("string"), F.lit(""))
    runs = docs.select(ident.alias("id"), found.alias("run")).select("id", lowered(F.col("run")).alias("word"))
    if spoil is not None:
        h = F.crc32(F.concat("id", F.lit(":"), "word").cast("binary"))
        at = F.pmod("h", F.length("word")).cast("int")
        cut = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
        runs = runs.withColumn("h", h).select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("word")).alias("word"))
    counted = runs.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where((F.length("word") >= min_letters) & (F.col("n") >= min_count))


def parts_of(word: str, ranks: dict[str, int], parts: int) -> list[str]:
    """A word's multiset cut into parts: letters, each as often as it falls there.

    The letter of rank r (by frequency) falls into part r + k, modulo the parts, at its
    k-th occurrence, so that frequent letters are spread evenly.
    """
    held: list[list[str]] = [[] for _ in range(parts)]
    for letter, times in sorted(Counter(word).items()):
        rank = ranks.get(letter, 0)
        for k in range(times):
            held[(rank + k) % parts].append(f"{letter}{k}")
    return [" ".join(h) for h in held]


def signatures(word: str, ranks: dict[str, int], distance: int, first: int, second: int, tag: int) -> Iterator[int]:
    """Hashes of the signatures and the tag: what is equal by chance falls to the check.

    Among ``first`` groups of parts one holds at most (distance + 1) / first - 1
    differences, rounded up; leaving out as many of its ``second`` parts as that, in every
    possible way, leaves the same contents at least once.
    """
    spared = -(-(distance + 1) // first) - 1
    parts = parts_of(word, ranks, first * second)
    for group in range(first):
        own = range(group * second, (group + 1) * second)
        for k, kept in enumerate(combinations(own, second - spared)):
            whole = "|".join([f"{tag} {distance} {group} {k}", *(parts[i] for i in kept)])
            yield xxhash.xxh64_intdigest(whole) - (1 << 63)


def near_words(words: DataFrame, level: tuple = LEVEL, one_longer: tuple = ONE_LONGER) -> DataFrame:
    """(word, n, near, near_n): every ordered pair of words one letter apart.

    ``words`` holds different words with their counts and is a landed table. Words as long
    differ by a replaced letter, so by two in their multisets, words one longer by one.
    Either kind of pair shares a signature that carries the shorter length; each is
    checked where it meets, and what meets more than once is merged.
    """
    bounded_batches(words.sparkSession)
    letter = F.explode(F.array_distinct(F.regexp_extract_all("word", F.lit("(?s)."), F.lit(0)))).alias("letter")
    # one row for each letter there is
    rows = words.select(letter).groupBy("letter").count().collect()
    ranks = {r.letter: k for k, r in enumerate(sorted(rows, key=lambda r: (-r["count"], r.letter)))}
    # of words as long; of the longer and the shorter word of a pair
    kinds = [(2, *level, 0), (1, *one_longer, -1), (1, *one_longer, 0)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = []
            for distance, first, second, less in kinds:
                made = [
                    list(signatures(w, ranks, distance, first, second, len(w) + less))
                    for w in batch.column(0).to_pylist()
                ]
                ends = np.cumsum([0, *map(len, made)]).astype(np.int32)
                flat = pa.array([s for m in made for s in m], pa.int64())
                lists.append(pa.ListArray.from_arrays(pa.array(ends), flat))
            yield pa.RecordBatch.from_arrays([*batch.columns, *lists], names=["word", "n", "level", "longer", "shorter"])

    lists = "level array<long>, longer array<long>, shorter array<long>"
    signed = land(words.select("word", "n").mapInArrow(run, f"word string, n long, {lists}"), "signatures")

    def side(kind: str, word: str, n: str) -> DataFrame:
        return signed.select(F.explode(kind).alias("s"), F.col("word").alias(word), F.col("n").alias(n))

    near = F.levenshtein("word", "near", 1) == 1
    level_met = side("level", "word", "n").join(side("level", "near", "near_n"), "s").where((F.col("near") < F.col("word")) & near)
    apart_met = side("longer", "word", "n").join(side("shorter", "near", "near_n"), "s").where(near)
    met = level_met.union(apart_met).select("word", "n", "near", "near_n")
    pairs = land(met.distinct(), "near_words")
    return pairs.union(pairs.select("near", "near_n", "word", "n"))


def group_variants(words: DataFrame, min_ratio: int = MIN_RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for a landed table of (word, n).

    ``form`` is the near word with the largest count (the first in code-point order of
    equals) if that is at least ``min_ratio`` times the word's own; ``root`` follows
    forms to the last. Counts grow along the way, so it ends; each round doubles the
    steps taken, and at most about log2(log5(n)) rounds are needed. An empty table
    gives an empty result.
    """
    links = near_words(words)
    best = links.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    )
    joined = words.select("word", "n").join(best, "word", "left")
    wins = -F.col("best.less") >= min_ratio * F.col("n")
    formed = land(
        joined.select(
            "word", F.when(wins, F.col("best.near")).alias("form"), "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(wins, -F.col("best.less")).alias("form_n"),
        ),
        "forms",
    )
    up = formed.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        further = up.select(F.col("word").alias("root"), F.col("root").alias("last"))
        up = land(
            up.join(further, "root", "left").select(
                "word", F.coalesce("last", "root").alias("root"), F.col("last").isNotNull().alias("moved")
            ),
            "roots",
        )
        if up.where("moved").isEmpty():
            break
        up = up.drop("moved")
    return formed.join(up.select("word", "root"), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
