"""Personal data: patterns, and terms that reveal what the patterns protect.

The protected entities are the matched values. A term (a word of four letters or
more) discloses an entity when its pointwise mutual information with it, over the
documents of the corpus, is at least ALPHA of the entity's own information content:
log p(e|t)/p(e) >= ALPHA * -log p(e). For p(e|t) stands the lower end of its Wilson
interval (one-sided, 80 percent), over texts that differ outside personal data: thin
evidence counts for less, but no least number of meetings is asked for. So a word that
occurs only beside an address that is named once discloses it, a common word does not.
Terms are looked for where the entity stands; one that always comes with it, in more
than one text, is removed, others are generalised.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mixloom.llm.common import bounded_batches, land, with_text

KINDS = ("email", "ip", "card", "phone")
ADDED = ("term", "removed")
ALPHA = 0.9
# quantile of the one-sided interval of 80 percent
QUANTILE = 0.8416
# tasks that the copies of one text are dealt to
SALTS = 256

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# digits are taken whole, which leaves matches as they are and keeps long runs linear
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# ASCII letters and digits and everything beyond ASCII
_TERM_CLASS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_TERM = re.compile(_TERM_CLASS + "{4,}")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = str.maketrans(_UPPER, _LOWER)


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost addresses; the part before the sign is the longest run up to the last match."""
    last = 0
    for found in _DOMAIN.finditer(text):
        start = found.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < found.start():
            yield start, found.end()
            last = found.end()


def _luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) by start and kind."""
    out = []
    if "@" in text:
        out += [(a, b, 0) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), m.end(), 1))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), m.end(), 2))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda s: (s[0], s[2]))


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with spaces in the place of its spans."""
    parts, at = [], 0
    for start, end, _ in spans:
        if end > at:
            parts += [text[at : max(at, start)], " " * (end - max(at, start))]
            at = end
    return "".join(parts) + text[at:]


def terms(text: Column) -> Column:
    """Distinct terms, A-Z in lower case."""
    found = F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(_TERM_CLASS + "{4,}"), F.lit(0))
    return F.array_distinct(found)


def written(spans: list[tuple[int, int, int]]) -> str:
    names = KINDS + ADDED
    return ",".join(f"{names[k]}:{a}:{b}" for a, b, k in spans)


_FOUND = (
    "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, "
    "entities array<bigint>, context bigint, body string"
)


def find_base(docs: DataFrame, carry: list[str], text: str = "text") -> DataFrame:
    """The carried columns, base spans, distinct entities, and the text with base spans
    blanked and a hash of its words (only where there are any)."""
    columns = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)]
    head = docs.select(*columns)
    source, at = with_text(docs, carry, text)
    bounded_batches(docs.sparkSession)
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in head.schema), _FOUND])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[], [], [], []]
            shas, spans_out, entities, contexts, bodies = [], [], [], [], []
            for value in batch.column(at):
                own = value.as_py() or ""
                spans = base_spans(own)
                for k in range(4):
                    counts[k].append(sum(s[2] == k for s in spans))
                line = written(spans)
                shas.append(hashlib.sha256(line.encode()).hexdigest())
                spans_out.append(line)
                entities.append(sorted({_mark(f"{KINDS[k]}:{own[a:b]}") for a, b, k in spans}))
                bodies.append(masked(own, spans) if spans else None)
                contexts.append(_mark(" ".join(bodies[-1].split())) if spans else None)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[: len(carry)],
                    *[pa.array(c, pa.int64()) for c in counts],
                    pa.array(shas, pa.string()),
                    pa.array(spans_out, pa.string()),
                    pa.array(entities, pa.list_(pa.int64())),
                    pa.array(contexts, pa.int64()),
                    pa.array(bodies, pa.string()),
                ],
                names=[
                    *[f"c{i}" for i in range(len(carry))],
                    "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "entities",
                    "context", "body",
                ],
            )

    return source.mapInArrow(run, schema)


def _mark(value: str) -> int:
    return xxhash.xxh64_intdigest(value.encode()) - (1 << 63)


def least_share(given: Column, texts: Column, quantile: float = QUANTILE) -> Column:
    """Lower end of the Wilson interval of a share seen in so many texts."""
    square = quantile * quantile
    spread = F.sqrt(given * (1 - given) / texts + square / (4 * texts * texts))
    return (given + square / (2 * texts) - quantile * spread) / (1 + square / texts)


def entity_texts(found: DataFrame) -> DataFrame:
    """Texts with entities, equal ones once: (_of, context, entities, n, salts).

    ``_of`` is the first of their rows, ``n`` their number; ``salts`` are the remainders
    of the rows' numbers, at most SALTS.
    """
    units = found.where(F.size("entities") > 0).groupBy("context", "entities").agg(
        F.min("_row").alias("_of"),
        F.count(F.lit(1)).alias("n"),
        F.collect_set(F.pmod("_row", F.lit(SALTS))).alias("salts"),
    )
    return land(units, "entity_texts")


def entity_classes(units: DataFrame) -> DataFrame:
    """(_of, context, n, held): the classes of a text's entities, with their documents.

    Entities that stand in exactly the same texts have the same counts with every term.
    They are one class, named by a hash of its texts, so that a list of a thousand
    addresses in one document meets the document's terms once and not a thousand times.
    """
    each = units.select("_of", "n", F.explode("entities").alias("entity"))
    sums = each.groupBy("entity").agg(
        F.sum("n").alias("n_entity"),
        F.count(F.lit(1)).alias("texts"),
        F.bit_xor(F.xxhash64("_of")).alias("a"),
        F.bit_xor(F.xxhash64("_of", F.lit(1))).alias("b"),
    )
    named = land(sums.select("entity", "n_entity", F.xxhash64("a", "b", "texts").alias("class")), "entities")
    held = (
        each.join(named, "entity")
        .groupBy("_of")
        .agg(F.collect_set(F.struct("class", "n_entity")).alias("held"))  # a document's own entities at most
    )
    return land(units.select("_of", "context", "n").join(held, "_of"), "held")


def disclosing_terms(
    found: DataFrame, held: DataFrame, corpus: DataFrame, total: int, alpha: float = ALPHA
) -> DataFrame:
    """(class, term, certain) of terms that disclose the entities of a class.

    ``found`` has row, entities and body, ``held`` is that of ``entity_classes``,
    ``corpus`` one column of texts. Documents are counted with their copies, but the
    interval is as wide as the number of different texts makes it, so copies alone prove
    nothing, while a signature that is the same in different texts does. Terms too common
    to disclose are left before classes and terms are brought together; terms and pairs
    are counted within tasks before they are shuffled. The term of a hot join key stands
    once on the side of the counts, so adaptive execution can split the other side.
    """
    by_row = (
        held.select("_of", "context", "n", F.inline("held"))
        .groupBy("class", "n_entity", "context")
        .agg(F.min("_of").alias("_of"), F.sum("n").alias("n"))
        .groupBy("_of")
        .agg(F.collect_list(F.struct("class", "n_entity", "n")).alias("held"))
    )
    (name,) = corpus.columns
    frequency = (
        corpus.select(F.explode(terms(F.col(f"`{name}`"))).alias("term"))
        .groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    )
    bar = F.pow(F.col("n_entity") / F.lit(float(max(total, 1))), F.lit(1.0 - alpha))
    given = F.least(F.col("together") / F.col("n_term"), F.lit(1.0))
    return (
        found.where(F.size("entities") > 0).select("_row", "body")
        .join(by_row, F.col("_row") == F.col("_of"))
        .select("held", F.explode(terms(F.col("body"))).alias("term"))
        .join(frequency, "term")
        .select("term", "n_term", F.inline("held"))
        .where((F.col("n_entity") >= bar * F.col("n_term")) & (F.col("n_entity") < total))
        .groupBy("class", "n_entity", "term", "n_term")
        .agg(F.sum("n").alias("together"), F.count(F.lit(1)).alias("texts"))
        .where(least_share(given, F.col("texts") / given) >= bar)
        .select("class", "term", ((given >= 1.0) & (F.col("texts") > 1)).alias("certain"))
    )


def told_terms(found: DataFrame, units: DataFrame, held: DataFrame, disclosing: DataFrame) -> DataFrame:
    """(_context, _entities, _salt, told): the terms to take out of each text with entities.

    A term that discloses a class fills a stated share of the documents that hold it, so
    few classes can have it, and the join by term stays near the number of terms. The copies
    of a text find its terms under several keys, one for each remainder of their numbers.
    """
    told = (
        found.where(F.size("entities") > 0).select("_row", "body")
        .join(held.select("_of", F.col("held.class").alias("classes")), F.col("_row") == F.col("_of"))
        .select("_of", "classes", F.explode(terms(F.col("body"))).alias("term"))
        .join(disclosing, "term")
        .where(F.array_contains("classes", F.col("class")))
        .groupBy("_of", "term").agg(F.max("certain").alias("certain"))
        .groupBy("_of").agg(F.collect_list(F.struct("term", "certain")).alias("told"))  # a document's own terms
    )
    return units.join(told, "_of").select(
        F.col("context").alias("_context"), F.col("entities").alias("_entities"),
        F.explode("salts").alias("_salt"), "told",
    )


def detect(
    docs: DataFrame, carry: list[str] | None = None, text: str = "text", alpha: float = ALPHA
) -> DataFrame:
    """The carried columns (all by default) with n_email, n_ip, n_card, n_phone,
    base_sha256 and spans (``kind:start:end`` by start, then kind, in code points).

    A null text is empty and has no spans. Rows are told apart by a stored number,
    so repeated and null ids do no harm. Added spans may lie anywhere outside base
    spans, which all stay. Carried columns of the names above, however they are
    capitalised, are replaced.
    """
    out = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    carry = [c for c in (docs.columns if carry is None else carry) if c.lower() not in out]
    found = land(
        find_base(docs, carry, text).withColumn("_row", F.monotonically_increasing_id()), "private"
    )
    total = found.count()
    units = entity_texts(found)
    held = entity_classes(units)
    corpus = docs.select(F.col(f"`{text}`").alias("text"))
    disclosing = land(disclosing_terms(found, held, corpus, total, alpha), "disclosing")
    told = land(told_terms(found, units, held, disclosing), "told")
    columns = [*(f"c{i}" for i in range(len(carry))), *out]
    same = (
        (F.col("context") == F.col("_context"))
        & (F.col("entities") == F.col("_entities"))
        & (F.pmod("_row", F.lit(SALTS)) == F.col("_salt"))
    )
    joined = found.where(F.col("spans") != "").join(told, same, "left").select(
        *columns, F.coalesce("body", F.lit("")).alias("body"), "told"
    )
    schema = found.select(*columns).schema

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = []
            for line, body, told in zip(*(batch.column(c) for c in ("spans", "body", "told"))):
                lines.append(add_terms(line.as_py(), body.as_py(), told.as_py()) if told.is_valid else line.as_py())
            kept = [batch.column(c) for c in columns[:-1]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(lines, pa.string())], names=columns)

    rows = found.where(F.col("spans") == "").select(*columns).union(joined.mapInArrow(add, schema))
    return rows.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], *out)


def read_spans(line: str) -> list[tuple[int, int, int]]:
    names = KINDS + ADDED
    parts = (x.split(":") for x in line.split(",") if x)
    return [(int(a), int(b), names.index(k)) for k, a, b in parts]


def add_terms(line: str, body: str, told: list[dict]) -> str:
    """Base spans and those of the told terms, which are looked for outside base spans."""
    certain = {t["term"]: t["certain"] for t in told}
    spans = read_spans(line)
    for m in _TERM.finditer(body):
        term = m.group().translate(_FOLD)
        if term in certain:
            spans.append((m.start(), m.end(), len(KINDS) + certain[term]))
    return written(sorted(spans, key=lambda s: (s[0], s[2])))


def redacted(text: str, line: str) -> str:
    """Base spans and generalised terms become their kind in brackets, others vanish.

    Spans of several kinds that overlap are replaced together, by the first's kind.
    """
    names = KINDS + ADDED
    parts, at = [], 0
    for start, end, kind in read_spans(line):
        if start >= at:
            parts += [text[at:start], "" if names[kind] == "removed" else f"[{names[kind].upper()}]"]
        at = max(at, end)
    return "".join(parts) + text[at:]


def redact(found: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """All columns, with the spans taken out of the text; null texts stay null."""
    names = found.columns
    place = names.index(text), names.index(spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lines = batch.column(place[0]).to_pylist(), batch.column(place[1]).to_pylist()
            new = [t if not s or t is None else redacted(t, s) for t, s in zip(texts, lines)]
            columns = list(batch.columns)
            columns[place[0]] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return found.mapInArrow(run, found.schema)
