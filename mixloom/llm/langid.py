"""Language identification by cross-parsing against suffix automata.

For each language the labelled sample is turned into a suffix automaton, which
walks exactly the substrings of the sample. A text is parsed into the longest
pieces that the automaton walks; each piece costs about log2 of the sample's
length. The language with the fewest bits a character wins.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixloom.llm.common import bounded_batches, with_text

PIECE = 500
SAMPLE_CHARS = 60_000
MAX_LANGUAGES = 64
BLOCK = 1024
SYMBOLS = 128
_CODES = 0x110000
_LANES = 4096


@lru_cache(maxsize=1)
def _folding() -> tuple[np.ndarray, np.ndarray]:
    """Lower case of every code point, and whether it is a letter."""
    lower = np.arange(_CODES, dtype=np.int32)
    letter = np.zeros(_CODES, bool)
    for code in range(_CODES):
        if 0x3400 <= code < 0x4DC0 or 0x4E00 <= code < 0xA000 or 0xAC00 <= code < 0xD7A4 or 0x20000 <= code < 0x323B0:
            letter[code] = True
            continue
        if 0xD800 <= code < 0xF900 or code >= 0x323B0:
            continue
        char = chr(code)
        if char.isalpha():
            letter[code] = True
            small = char.lower()
            if len(small) == 1:
                lower[code] = ord(small)
    return lower, letter


def letters(text: str) -> np.ndarray:
    """Lower-cased code points; each run of anything but letters becomes one space."""
    lower, letter = _folding()
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
    is_letter = letter[codes]
    folded = np.where(is_letter, lower[codes], 32)
    first = np.ones(len(codes), bool)
    first[1:] = is_letter[:-1]
    return folded[is_letter | first]


@dataclass(frozen=True)
class Language:
    name: str
    size: int
    #: own symbol by the model's letter; its letters by falling frequency, ``width - 1``
    #: for letters that it does not have, and from ``width`` on the rarer ones it has
    own: np.ndarray
    width: int
    #: next state by state * width + symbol; state 0 is the start, 0 means none
    steps: np.ndarray
    #: state * len(own) + symbol of the steps by rarer letters, sorted, and the next states
    keys: np.ndarray
    targets: np.ndarray
    #: next state from the start by own symbol
    start: np.ndarray


@dataclass(frozen=True)
class Model:
    languages: list[Language]
    #: letter number by code point, of every letter in a sample; one more stands for all others
    symbols: dict[int, int]

    @property
    def width(self) -> int:
        return len(self.symbols) + 1


def suffix_automaton(symbols: np.ndarray) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a symbol sequence, by state."""
    steps: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for symbol in symbols.tolist():
        state = len(steps)
        steps.append({})
        link.append(0)
        length.append(length[last] + 1)
        at = last
        while at >= 0 and symbol not in steps[at]:
            steps[at][symbol] = state
            at = link[at]
        if at >= 0:
            target = steps[at][symbol]
            if length[target] == length[at] + 1:
                link[state] = target
            else:
                twin = len(steps)
                steps.append(dict(steps[target]))
                link.append(link[target])
                length.append(length[at] + 1)
                link[target] = link[state] = twin
                while at >= 0 and steps[at].get(symbol) == target:
                    steps[at][symbol] = twin
                    at = link[at]
        last = state
    return steps


def build_model(samples: dict[str, list[str]]) -> Model:
    """Automata of the given texts, each over all letters of its own text."""
    texts = {name: letters("\n".join(parts)) for name, parts in sorted(samples.items())}
    texts = {name: codes for name, codes in texts.items() if (codes != 32).any()}
    seen = np.unique(np.concatenate(list(texts.values()))) if texts else np.empty(0, np.int64)
    languages = [_language(name, np.searchsorted(seen, codes), len(seen) + 1) for name, codes in texts.items()]
    return Model(languages, {code: n for n, code in enumerate(seen.tolist())})


def _language(name: str, text: np.ndarray, n_letters: int) -> Language:
    """The most frequent letters step through a table, the others through sorted keys."""
    values, counts = np.unique(text, return_counts=True)
    values = values[np.lexsort((values, -counts))]
    dense = min(len(values), SYMBOLS - 1)
    own = np.full(n_letters, dense, np.int32)
    own[values[:dense]] = np.arange(dense)
    own[values[dense:]] = np.arange(dense + 1, len(values) + 1)
    states = suffix_automaton(own[text])
    width = dense + 1
    table = np.zeros((len(states), width), np.int32)
    rare: dict[int, int] = {}
    for state, out in enumerate(states):
        for symbol, target in out.items():
            if symbol < width:
                table[state, symbol] = target
            else:
                rare[state * n_letters + symbol] = target
    keys = np.array(sorted(rare), np.int64)
    start = np.zeros(max(n_letters, width) + 1, np.int32)
    for symbol, target in states[0].items():
        start[symbol] = target
    targets = np.array([rare[k] for k in keys.tolist()], np.int32)
    return Language(name, len(text), own, width, table.reshape(-1), keys, targets, start)


def count_phrases(blocks: np.ndarray, lengths: np.ndarray, language: Language) -> np.ndarray:
    """Phrases of each row of the model's letters; rows are sorted by falling length."""
    state = np.zeros(len(blocks), np.int32)
    count = np.zeros(len(blocks), np.int64)
    steps, width, start, keys = language.steps, language.width, language.start, language.keys
    columns = language.own.take(np.ascontiguousarray(blocks.T))
    for at in range(blocks.shape[1]):
        live = int(np.searchsorted(-lengths, -at, "left"))
        if not live:
            break
        symbol, here = columns[at, :live], state[:live]
        if len(keys):
            found = steps.take(here * width + np.minimum(symbol, width - 1))
            rare = np.flatnonzero(symbol >= width)
            wanted = here[rare].astype(np.int64) * len(language.own) + symbol[rare]
            place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            found[rare] = np.where(keys[place] == wanted, language.targets[place], 0)
        else:
            found = steps.take(here * width + symbol)
        stuck = np.flatnonzero(found == 0)
        if len(stuck):
            again = start.take(symbol[stuck])
            count[stuck] += (here[stuck] != 0).astype(np.int64) + (again == 0)
            found[stuck] = again
        state[:live] = found
    return count + (state != 0)


class Parser:
    """Rates of texts under a model; texts are parsed in blocks of BLOCK letters."""

    def __init__(self, model: Model):
        self.model = model
        self.to_symbol = np.full(_CODES, model.width - 1, np.int32)
        for code, symbol in model.symbols.items():
            self.to_symbol[code] = symbol

    def rates(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Bits a character of each text (rows) and language (columns); texts with letters."""
        model = self.model
        phrases = np.zeros((len(texts), len(model.languages)))
        chars = np.zeros(len(texts), np.int64)
        lettered = np.zeros(len(texts), bool)
        lanes: list[np.ndarray] = []
        owner: list[int] = []

        def flush():
            if not lanes:
                return
            lengths = np.array([len(x) for x in lanes])
            order = np.argsort(-lengths, kind="stable")
            blocks = np.zeros((len(lanes), int(lengths.max())), np.int32)
            for row, i in enumerate(order):
                blocks[row, : lengths[i]] = lanes[i]
            own = np.array(owner)[order]
            for k, language in enumerate(model.languages):
                n = count_phrases(blocks, lengths[order], language)
                np.add.at(phrases[:, k], own, n)
            lanes.clear()
            owner.clear()

        for i, text in enumerate(texts):
            codes = letters(text) if text else np.empty(0, np.int64)
            if not (codes != 32).any():
                continue
            lettered[i] = True
            chars[i] = len(codes)
            mapped = self.to_symbol[codes]
            for at in range(0, len(mapped), BLOCK):
                lanes.append(mapped[at : at + BLOCK])
                owner.append(i)
                if len(lanes) >= _LANES:
                    flush()
        flush()
        bits = np.array([np.log2(x.size + 1) for x in model.languages])
        return phrases * bits / np.maximum(chars, 1)[:, None], lettered


def sample_languages(
    labelled: DataFrame, sample_chars: int = SAMPLE_CHARS, max_languages: int = MAX_LANGUAGES
) -> dict[str, list[str]]:
    """A bounded sample of (text, lang) rows: pieces of texts drawn by their hash.

    Texts are cut into pieces of PIECE characters all along; each language gives
    at most ``sample_chars`` characters of different pieces, the ``max_languages``
    with most characters take part and a warning names (up to as many) others. Only this sample reaches the driver.
    """
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = (
        rows.groupBy("lang").agg(F.sum(F.length("text")).alias("n"))
        .orderBy(F.desc("n"), "lang").limit(2 * max_languages).collect()
    )
    if not sizes:
        return {}
    if len(sizes) > max_languages:
        left_out = ", ".join(r.lang for r in sizes[max_languages:])
        warnings.warn(f"more than max_languages={max_languages} languages; not learned: {left_out}", stacklevel=2)
        sizes = sizes[:max_languages]
    # twice the share that is needed, as copies fall away
    share = F.lit(0.0)
    for row in sizes:
        share = F.when(F.col("lang") == row.lang, min(1.0, 2.0 * sample_chars / max(row.n, 1))).otherwise(share)
    piece = F.explode(
        F.transform(
            F.sequence(F.lit(0), F.floor((F.length("text") - 1) / PIECE).cast("int")),
            lambda i: F.substr("text", i * PIECE + 1, F.lit(PIECE)),
        )
    )
    hashed = F.pmod(F.xxhash64("piece"), F.lit(1 << 40))
    # each share bounds its own language, however short its texts are: about twice
    # sample_chars are expected, so there is no common limit for a frequent one to fill
    drawn = (
        rows.where(F.length("text") > 0)
        .select("lang", piece.alias("piece"))
        .where(hashed < share * F.lit(float(1 << 40)))
        .select("lang", "piece", hashed.alias("h"))
        .distinct()
        .toArrow()
    )
    samples: dict[str, list[str]] = {}
    left = {row.lang: sample_chars for row in sizes}
    for _, lang, piece in sorted(zip(*(drawn.column(c).to_pylist() for c in ("h", "lang", "piece")))):
        if left[lang] > 0:
            samples.setdefault(lang, []).append(piece[: left[lang]])
            left[lang] -= len(piece)
    return samples


def identify(
    docs: DataFrame, samples: dict[str, list[str]], text: str = "text", carry: list[str] | None = None
) -> DataFrame:
    """The carried columns (all by default) with ``lang_pred`` and ``score``.

    ``lang_pred`` is ``und`` with score 0 for null texts, texts without letters and
    where nothing was learned. Otherwise the score is the runner-up's share of both
    rates (1 if only one language is known): 0.5 for a tie, which goes to the first
    name. Input columns of these two names are replaced.
    """
    wanted = docs.columns if carry is None else carry
    carried = [c for c in wanted if c not in ("lang_pred", "score")]
    columns = [F.col(f"`{c}`") for c in carried]
    schema = docs.select(
        *columns, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")
    ).schema
    spark = docs.sparkSession
    bounded_batches(spark)
    source, at = with_text(docs, carried, text)
    shared = spark.sparkContext.broadcast(samples)  # bounded by sample_chars x max_languages
    content = sha256(repr(sorted(samples.items())).encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser(content, shared)
        names = [x.name for x in parser.model.languages]
        for batch in batches:
            rates, lettered = parser.rates(batch.column(at).to_pylist())
            if len(names) > 1:
                two = np.partition(rates, 1, axis=1)[:, :2]
                score = two[:, 1] / np.maximum(two.sum(1), 1e-300)
            else:
                score = np.ones(len(rates))
            known = lettered & bool(names)
            best = rates.argmin(1) if names else np.zeros(len(rates), int)
            found = [names[b] if k else "und" for b, k in zip(best, known)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(carried)], pa.array(found, pa.string()), pa.array(np.where(known, score, 0.0))],
                names=[*carried, "lang_pred", "score"],
            )

    return source.mapInArrow(run, schema)


_parsers: dict[str, Parser] = {}


def _parser(content: str, shared) -> Parser:
    """One parser per worker process and content of the samples; workers are used again."""
    if content not in _parsers:
        _parsers.clear()
        _parsers[content] = Parser(build_model(shared.value))
    return _parsers[content]
