"""Text operators against plain Python versions, and odd rows."""

import hashlib
import math
import random
import re
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from mixloom.llm import bpe, chat, langid, packing, pii, simhash, suffixtree, warc
from mixloom.llm.common import land, pack, unpack
from mixloom.llm.components import connected_components
from mixloom.llm.queries import QUERIES, fold

SF = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_50k.json")
CLASH = ["_row", "_fp", "_text", "component_id", "kept", "score", "lang_pred", "chunk", "part", "spans", "ids", "words", "n", "c0"]
ODD = [
    (1, None), (2, ""), (3, "same few words in here"), (3, "same few words in here"), (None, "without an id"),
    (None, None), (4, " \n\t"), (5, "x" * 70_000 + " é"), (6, "12 34 !?"), (7, "Ünï <|endoftext|> ok"), (8, "a b " * 20_000),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = spark.createDataFrame(ODD, "doc_id long, text string").withColumn("lang", F.lit("en"))
    return land(rows.withColumns({c: F.lit(1) for c in CLASH}), "odd")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}


def plain_components(nodes, pairs):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)]
    edges += [(i, i + 1) for i in range(300, 340)] + [(500, i) for i in range(501, 560)]
    df = spark.createDataFrame(edges + [(None, 3), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    want = plain_components(nodes, [e for e in edges if e[0] != e[1]])
    assert got == want
    assert connected_components(df.where("a < 0")).count() == 0


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    bits = Counter(b for g in grams for b in range(64) if xxhash.xxh64_intdigest(g, 42) >> b & 1)
    return sum(1 << b for b, n in bits.items() if 2 * n > len(grams))


def test_simhash_components(docs, texts):
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    near = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    want = plain_components(prints, near)
    rows = simhash.near_duplicates(docs, carry=[]).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id, r.kept) for r in rows} == {
        i: (f"{prints[i]:016x}", want[i], want[i] == i) for i in prints
    }
    assert len(near) > 0


def test_near_duplicate_stage_keeps_one_of_each_group(spark, docs, texts, odd):
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    near = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(plain_components(prints, near).values())
    assert simhash.near_duplicates(odd).count() == len(ODD)
    assert simhash.near_duplicates(odd.where("false")).count() == 0


@pytest.mark.parametrize("bits", [0, 1, 2, 3])
def test_ring_finds_all_pairs(bits):
    rng = np.random.default_rng(bits)
    base = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    fps = set(base.tolist())
    for x in base.tolist():
        for _ in range(20):
            y = x
            for b in rng.integers(0, 64, rng.integers(1, 6)):
                y ^= 1 << int(b)
            fps.add(y)
    fps = np.array(sorted(fps), np.uint64)
    found = set()
    for turn in range(4):
        keys = ((fps >> np.uint64(16 * turn)) & np.uint64(0xFFFF)).astype(np.int64) | (turn << 16)
        after = (fps >> np.uint64(16 * ((turn + 1) % 4))) & np.uint64(0xFFFF)
        order = np.lexsort((after, keys))
        for a, b in simhash.chain_pairs(fps[order], keys[order], bits):
            found |= {tuple(sorted(p)) for p in zip(order[a].tolist(), order[b].tolist())}
    apart = np.bitwise_count(fps[:, None] ^ fps[None, :])
    assert found == {(int(a), int(b)) for a, b in zip(*np.nonzero(apart <= bits)) if a < b}


def test_simhash_odd_rows(odd):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    empty = [r for r in rows if not (r.text or "").split()]
    assert {r.fingerprint for r in empty} == {"0" * 16} and {r.component_id for r in empty} == {1}
    assert sum(r.kept for r in rows) == len({r.fingerprint for r in rows})
    assert simhash.near_duplicates(odd.where("false")).count() == 0


def test_phrases_are_longest_matches():
    rng = random.Random(1)
    for _ in range(40):
        sample = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 60)))
        text = "".join(rng.choice("abcd ") for _ in range(rng.randint(1, 50)))
        model = langid.build_model({"x": [sample + "a"]})
        known = "".join(map(chr, langid.letters(sample + "a")))
        codes = "".join(map(chr, langid.letters(text)))
        at = phrases = 0
        while at < len(codes):
            n = 0
            while at + n < len(codes) and codes[at : at + n + 1] in known:
                n += 1
            at += max(n, 1)
            phrases += 1
        rates, lettered = langid.Parser(model).rates([text])
        want = phrases * math.log2(len(known) + 1) / max(len(codes), 1)
        assert lettered[0] == any(c.isalpha() for c in text)
        if lettered[0]:
            assert rates[0, 0] == pytest.approx(want)


def test_languages_of_held_out_documents(spark, docs):
    rows = QUERIES["op5_cross_parsing_langid"](spark, SF).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang == r.lang_pred for r in held]) >= 0.95


def test_language_odd_rows(odd):
    samples = langid.sample_languages(odd)
    got = langid.identify(odd, samples).select("text", "lang_pred", "score").collect()
    assert len(got) == len(ODD)
    for r in got:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
    assert langid.sample_languages(odd.where("false")) == {}
    assert {r.lang_pred for r in langid.identify(odd, {}).collect()} == {"und"}


def test_models_do_not_outlive_their_samples_in_workers(spark):
    tongues = {f"t{i}": "".join(chr(97 + (i * 7 + k * k) % 26) for k in range(40)) for i in range(20)}
    rows = land(spark.createDataFrame([(n, t) for n, t in tongues.items()], "name string, text string"), "tongues")
    for name, sample in tongues.items():
        got = langid.identify(rows, {name: [sample], "other": ["?" * 40]}).collect()
        assert {r.name: r.lang_pred for r in got}[name] == name
        assert {r.lang_pred for r in got} <= {name, "other"}


def test_hexagrams_are_no_letters_and_dropped_languages_are_named(spark):
    assert langid.identify(
        spark.createDataFrame([("\u4dc0\u4dff \u4dc1",)], "text string"), {"en": ["abc"]}
    ).first().lang_pred == "und"
    rows = spark.createDataFrame([("one text", f"l{i}") for i in range(4)], "text string, lang string")
    with pytest.warns(UserWarning, match="l3"):
        assert set(langid.sample_languages(rows, max_languages=3)) == {"l0", "l1", "l2"}


def test_rare_language_beside_short_texts_of_a_frequent_one(spark):
    frequent = spark.range(40_000).select(F.lit("en").alias("lang"), F.concat(F.lit("text "), F.sha1(F.col("id").cast("string"))).alias("text"))
    rare = spark.range(200).select(F.lit("xx").alias("lang"), F.concat(F.lit("rare "), F.sha1(F.col("id").cast("string"))).alias("text"))
    samples = langid.sample_languages(frequent.union(rare))
    assert len(samples["xx"]) == 200 and 59_900 <= sum(map(len, samples["en"])) <= 60_000


def test_languages_with_more_letters_than_a_table_holds():
    rng = random.Random(6)
    words = {
        name: ["".join(chr(low + rng.randrange(2000)) for _ in range(2)) for _ in range(300)]
        for name, low in (("han", 0x4E00), ("more", 0x5000), ("hangul", 0xAC00))
    }
    text = lambda name: "".join(rng.choice(words[name]) for _ in range(400))
    # samples of unlike size: without its letters, the smallest sample would win
    model = langid.build_model({n: [text(n) for _ in range(k)] for n, k in (("han", 8), ("more", 4), ("hangul", 1))})
    for name in words:
        rates, _ = langid.Parser(model).rates([text(name) for _ in range(5)])
        assert {model.languages[k].name for k in rates.argmin(1)} == {name}
    # a letter that no sample holds is a phrase of its own, a rare known one is walked
    known = "".join(map(chr, range(0x4E00, 0x4E00 + 400)))
    one = langid.build_model({"x": [known]})
    rates, _ = langid.Parser(one).rates([known, known[::-1], "a" + known[5:300] + "b"])
    assert np.allclose(rates[:, 0], math.log2(401) * np.array([1 / 400, 1, 3 / 297]))


def test_packing_round_trip(spark, texts):
    check_packing(QUERIES["op6_linear_grouping_pack"](spark, SF).collect(), texts.items())


def check_packing(rows, docs):
    coder = Tokenizer.from_file(BPE)
    want = Counter()
    for i, text in docs:
        ids = np.array(coder.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        cut = len(ids) % 1024 or 1024
        spans = [(0, min(cut, len(ids))), *((a, a + 1024) for a in range(cut, len(ids), 1024))]
        want.update((i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(spans))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for placed in sequences.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r.length for r in rows)
    assert len(sequences) <= 1.02 * total / 1024 + 2


def test_packing_odd_rows(odd):
    check_packing(packing.pack_sequences(odd, BPE).collect(), ODD)
    assert packing.pack_sequences(odd.where("false"), BPE).count() == 0


def test_packing_plans_use_every_length():
    rng = random.Random(3)
    for _ in range(100):
        lengths = Counter({rng.randint(1, 60): rng.choice([1, 2, 17, 900]) for _ in range(rng.randint(0, 12))})
        used = Counter()
        for contents, often in packing.plan_packing(dict(lengths), 60, groups=5):
            assert sum(contents) <= 60
            used.update({n: c * often for n, c in Counter(contents).items()})
        assert used == lengths


def test_bpe_equals_the_library(spark, odd, texts):
    coder = Tokenizer.from_file(BPE)
    rows = QUERIES["op9_word_table_bpe"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = coder.encode(texts[r.doc_id], add_special_tokens=False).ids
        text = coder.decode(ids, skip_special_tokens=False)
        want = (len(ids), ",".join(map(str, ids)), text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (want[0], *(hashlib.sha256(x.encode()).hexdigest() for x in want[1:]))
    got = bpe.decode(bpe.encode(odd, BPE, carry=["doc_id", *CLASH[:3]]), BPE).collect()
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in got) == Counter(
        (i, tuple(coder.encode(t or "", add_special_tokens=False).ids), t or "") for i, t in ODD
    )
    assert bpe.encode(odd.where("false"), BPE).count() == 0


def test_bpe_words_of_any_script(spark):
    rng = random.Random(5)
    signs = "aZé'sdt 19٣½!?.\n\t\r\x0b\x85\xa0  　日本🙂🏽\x00\x1c<|>"
    lines = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    lines += ["x<|endoftext|> y", "  <|endoftext|><|endoftext|>!", "we'll I'LL"]
    frame = land(spark.createDataFrame(list(enumerate(lines)), "i long, text string"), "lines")
    coder = Tokenizer.from_file(BPE)
    for r in bpe.encode(frame, BPE).collect():
        assert list(r.ids) == coder.encode(lines[r.i], add_special_tokens=False).ids


BASE = [
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(re.sub("[ -]", "", m)) <= 19 and plain_luhn(re.sub("[ -]", "", m))),
    (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
]


def plain_luhn(digits):
    doubled = [int(c) * (2 if k % 2 else 1) for k, c in enumerate(digits[::-1])]
    return sum(d // 10 + d % 10 for d in doubled) % 10 == 0


def plain_spans(text):
    found = [
        (m.start(), m.end(), k) for k, (p, fine) in enumerate(BASE) for m in re.finditer(p, text) if fine(m.group())
    ]
    return sorted(found, key=lambda s: (s[0], s[2]))


def test_base_spans():
    rng = random.Random(2)
    for _ in range(5000):
        text = "".join(rng.choice("aB1.@-+ 012(%)é_") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(text) == plain_spans(text)
    assert pii.base_spans("4" * 100_000 + "a" * 100_000) == []


def test_terms_that_disclose(spark):
    rows, k = [], 0
    for i in range(6):
        rows.append((k := k + 1, f"line {i} xylo{i}q says Quellenburg wrote from bob@ex.org on common ground {i}"))
    rows += [((k := k + 1), f"common ground without anything {i}") for i in range(200)]
    rows += [((k := k + 1), "copy Zanzig of a@b.cd text")] * 30
    df = land(spark.createDataFrame(rows, "doc_id long, text string"), "told")
    got = pii.detect(df).collect()
    assert len(got) == len(rows)
    for r in got:
        spans = pii.read_spans(r.spans)
        added = {r.text[a:b] for a, b, kind in spans if kind >= 4}
        assert [s for s in spans if s[2] < 4] == plain_spans(r.text)
        if "bob@" in r.text:  # six surroundings, and the word comes with nothing else
            assert "Quellenburg" in added and "common" not in added and "ground" not in added
        else:  # copies alone prove nothing, documents without entities are left alone
            assert not added
    clean = {r.doc_id: r.text for r in pii.redact(pii.detect(df)).collect()}
    assert "[EMAIL]" in clean[1] and "Quellenburg" not in clean[1] and clean[10] == rows[9][1]


def plain_disclosed(docs):
    """{row: spans line} of (row, text) by plain counting."""
    found = {i: (t or "", plain_spans(t or "")) for i, t in docs}
    fold = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    words = lambda t: {w.translate(fold) for w in re.findall(r"[0-9a-zA-Z\x80-\U0010ffff]{4,}", t)}
    body, holds, whole = {}, {}, Counter()
    for i, (t, spans) in found.items():
        whole.update(words(t))
        chars = list(t)
        for a, b, _ in spans:
            chars[a:b] = " " * (b - a)
        body[i] = "".join(chars)
        for a, b, k in spans:
            holds.setdefault((k, t[a:b]), set()).add(i)
    told = {}
    z, alpha = 0.8416, 0.9
    for entity, rows in holds.items():
        bar = (len(rows) / len(found)) ** (1 - alpha)
        met = {}
        for i in rows:
            for w in words(body[i]):
                met.setdefault(w, set()).add(i)
        for w, where in met.items():
            if not whole[w] or len(rows) == len(found):
                continue
            p = min(len(where) / whole[w], 1)
            texts = len({" ".join(body[i].split()) for i in where})
            n = texts / p
            low = (p + z * z / 2 / n - z * math.sqrt(p * (1 - p) / n + z * z / 4 / n / n)) / (1 + z * z / n)
            if low >= bar:
                for i in where:
                    told.setdefault(i, {})
                    told[i][w] = told[i].get(w, False) or (p == 1 and texts > 1)
    lines = {}
    for i, (t, spans) in found.items():
        spans = list(spans)
        for m in re.finditer(r"[0-9a-zA-Z\x80-\U0010ffff]{4,}", body[i]):
            w = m.group().translate(fold)
            if w in told.get(i, {}):
                spans.append((m.start(), m.end(), 4 + told[i][w]))
        lines[i] = pii.written(sorted(spans, key=lambda s: (s[0], s[2])))
    return lines


def test_disclosure_against_plain_counting(spark):
    rng = random.Random(5)
    common = [f"word{a}{b}" for a in "abcdefgh" for b in "abcdefgh"]
    rows = []
    for i in range(900):
        own = [rng.choice(common) for _ in range(12)]
        if i % 9 == 0:  # half of the addresses are named once, half come back
            name = f"p{i}" if i % 2 else f"p{i % 60}"
            own[3:3] = ["Rare" + "abcdefghij"[i // 9 % 10] * (3 + i // 90), f"{name}@mail.example"]
        if i % 45 == 0:
            own += [f"+49 30 {1000000 + i}", "Ünïcode", f"10.0.{i % 5}.7"]
        rows.append((i, " ".join(own)))
    rows += [(2000 + i, rows[9][1]) for i in range(40)]  # copies
    rows += [(3000 + i, f"fixed letter to x{i}@list.example about Quibbling") for i in range(30)]
    rows += [(4000, " ".join(f"a{i}@list.example" for i in range(300)) + " onlyhere someterms"), (4001, None), (4002, "")]
    df = land(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), "disclosed")
    got = {r.doc_id: r.spans for r in pii.detect(df, carry=["doc_id"]).collect()}
    want = plain_disclosed(rows)
    assert got == want
    assert "term" not in want[9] and "term" in want[27] and "removed" in "".join(want.values()) and "term" in want[4000]
    # sorted by any other order of rows, the result is the same
    again = {r.doc_id: r.spans for r in pii.detect(df.orderBy(F.desc("doc_id")), carry=["doc_id"]).collect()}
    assert again == want


def test_disclosure_query_against_plain_counting(spark):
    for sf in ("sf0.001", "sf0.01"):
        docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()]
        got = QUERIES["op8_disclosure_pii"](spark, f"/root/testdata/{sf}").collect()
        want = plain_disclosed(docs)
        assert len(got) == len(docs) and {r.doc_id: r.spans for r in got} == want


def test_clashing_names_of_any_case(spark):
    df = spark.createDataFrame([(1, "to a@b.cd", "x", 5)], "doc_id long, text string, SPANS string, N_Email int")
    (row,) = pii.detect(land(df, "cased")).collect()
    assert row.spans == "email:3:9" and row.n_email == 1 and len(row) == 8


def test_fixed_signature_in_different_texts_discloses(spark):
    end = "that is all for now. Kind regards, Jane Quellenburg, Acme <jane@acme.example> Tel. by request at any time"
    rows = [(i, f"text {i} of alpha{i}beta and so on, {end}") for i in range(8)]
    rows += [(100 + i, f"that is all for kind regards from anybody at request of time {i}") for i in range(300)]
    df = land(spark.createDataFrame(rows, "doc_id long, text string"), "signed")
    clean = {r.doc_id: r.text for r in pii.redact(pii.detect(df)).collect()}
    assert all("Quellenburg" not in clean[i] and "[EMAIL]" in clean[i] and "regards" in clean[i] for i in range(8))
    assert all(clean[i] == t for i, t in rows if i >= 100)


def test_personal_data_odd_rows(odd):
    got = pii.detect(odd).collect()
    assert len(got) == len(ODD) and {r.spans for r in got} == {""}
    assert pii.redact(pii.detect(odd)).count() == len(ODD)
    assert pii.detect(odd.where("false")).count() == 0


def plain_tree(lines):
    """Counts of words after contexts, retained contexts and P(w | context), by definition."""
    m, least = suffixtree.SMOOTHING, suffixtree.LEAST_GAIN
    one = Counter(x for w in lines for x in w)
    size = sum(one.values()) + len(one) + 1
    counts, depth = {}, 0
    p = lambda c, w: (
        (counts[c][w] + m * p(c[1:], w)) / (counts[c].total() + m) if c else (one[w] + 1) / size
    )
    kept, longer = set(), {()}
    while longer:
        depth += 1
        for w in lines:
            for k in range(depth, len(w)):
                if w[k - depth + 1 : k] in longer:
                    counts.setdefault(w[k - depth : k], Counter())[w[k]] += 1
        here = [c for c in counts if len(c) == depth and counts[c].total() > 1]
        longer = set()
        for c in here:
            n = counts[c].total()
            gain = sum(
                k * math.log((k - 1 + m * p(c[1:], w)) / (n - 1 + m) / p(c[1:], w)) for w, k in counts[c].items()
            )
            if gain >= least:
                kept.add(c)
            if sum(k * -math.log(p(c, w)) for w, k in counts[c].items() if k > 1) >= least:
                longer.add(c)
    return one, counts, kept, p


def plain_scores(docs, held):
    lines = [(i, tuple((t or "").encode().lower().split() + [b" "])) for i, t in docs]
    one, _, kept, p = plain_tree([w for i, w in lines if not held(i)])
    total, deepest = sum(one.values()), max(map(len, kept), default=0)
    for i, w in lines:
        score = 0.0
        for k, x in enumerate(w):
            contexts = (w[k - d : k] for d in range(min(k, deepest), 0, -1))
            score += math.log10(p(next((c for c in contexts if c in kept), ()), x))
        base = sum(math.log10(p((), x)) for x in w)
        yield i, held(i), len(w), sum(one[x] > 0 for x in w), total, base, score


def same_scores(got, want):
    key = lambda r: (str(r[0]), r[2], r[6])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9)


def test_suffix_tree_scores(spark, texts):
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    want = list(plain_scores(texts.items(), held))
    same_scores(QUERIES["op1_suffix_tree_lm"](spark, SF).collect(), want)
    assert sum(r[6] for r in want if r[1]) >= sum(r[5] for r in want if r[1])


def test_suffix_tree_deep_and_rare_contexts(spark):
    """Words told by those three and four places before, each context in few documents."""
    rng = random.Random(8)
    rows = []
    for i in range(90):
        rows.append((i, f"n{i} from x{i % 30} p q r{i % 30} so n{i + 1}"))
    for i in range(90, 210):
        rows.append((i, f"y{i % 20} s t u v{i % 20} and {rng.choice('abc')} {rng.choice('abc')} {rng.choice('abc')}"))
    rng.shuffle(rows)
    held = lambda i: i % 6 == 5
    lines = [tuple(t.encode().split() + [b" "]) for i, t in rows if not held(i)]
    _, counts, kept, _ = plain_tree(lines)
    assert min(counts[c].total() for c in kept if len(c) == 3) <= 3
    assert {1, 2, 3, 4} <= {len(c) for c in kept}
    for parts in (1, 7):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        got = suffixtree.score_documents(docs, F.col("doc_id") % 6 == 5).collect()
        same_scores(got, plain_scores(rows, held))


def test_suffix_tree_odd_rows(odd):
    got = suffixtree.score_documents(odd, F.col("doc_id") == 7).collect()
    same_scores(got, plain_scores(ODD, lambda i: i is None or i == 7))
    alone = suffixtree.score_documents(odd, F.lit(True)).collect()
    assert len(alone) == len(ODD) and {r.train_tokens for r in alone} == {0}
    assert suffixtree.score_documents(odd.where("false"), F.lit(True)).count() == 0


def test_suffix_tree_words():
    """Only ASCII white space parts words, only A-Z are lowered; one end a text."""
    odd = "".join(map(chr, range(1, 300)))
    texts = [odd, f"  {odd}\t", None, "", " \n", "a", "A\x0b\x0cB\x85\xa0c \x1fD\u2003E"]
    low = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    want = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low)) + [""] for t in texts]
    assert suffixtree.tokens(pa.array(texts, pa.string())).to_pylist() == want


def test_suffix_tree_numbers_and_groups(monkeypatch):
    rng = np.random.default_rng(3)
    for top in (40, 1 << 30):  # the larger ones do not fit beside their rows
        first, last = rng.integers(0, top, 5000), rng.integers(0, top, 5000)
        first[::3], last[::3] = first[0], last[0]
        a, b, place = suffixtree.numbered(first, last)
        want, inverse = np.unique(np.stack([first, last]), axis=1, return_inverse=True)
        assert (np.stack([a, b]) == want).all() and (place == inverse.reshape(-1)).all()
    columns = [rng.integers(0, 12, 4000).astype(np.uint32) for _ in range(3)]
    want = np.unique(np.stack(columns), axis=1).shape[1]
    same = lambda *ids: ids[0].astype(np.uint64)  # noqa: E731  (different rows of one key)
    for mixed in (suffixtree._mixed, same):
        monkeypatch.setattr(suffixtree, "_mixed", mixed)
        order, starts, group, first = suffixtree.grouped(columns)
        assert sorted(order) == list(range(4000)) and len(starts) == first.sum() == want
        met = {}
        assert all(met.setdefault(g, x) == x for g, x in zip(group, zip(*columns))) and len(set(met.values())) == want
        assert (group[order[starts]] == np.arange(want)).all()


def suffix_tree_level(c, parts):
    """Answer what a chunk asks for, as if it were all there is."""
    for name, ask, answer, width, sums in (
        ("items", c.ask_items, suffixtree._count, c.level + 1, 1),
        ("contexts", c.ask_contexts, suffixtree._retain, c.level, 4),
    ):
        if name == "contexts":
            c.count_items()
            c.sum_up(~c.context_alone)
        c.replies[name] = [
            suffixtree._packed(
                answer(
                    list(unpack(ids, np.uint32).reshape(width, -1)),
                    list(suffixtree._unpacked(own).reshape(sums, -1)),
                )
            )
            for _, _, ids, own in ask()
        ]
    c.judge_contexts()


def test_suffix_tree_level_is_landed_small():
    """A landed level holds no probabilities, and gives the same ones back; its chunk gets smaller."""
    rng = np.random.default_rng(4)
    parts, words, n = 5, 3000, 300_000
    codes = np.minimum(rng.zipf(1.3, n) - 1, words - 1).astype(np.uint32)
    sizes = np.full(300, n // 300)
    counts = np.bincount(codes, minlength=words)
    arrays = {
        "sizes": sizes, "held": (np.arange(300) % 7 == 2).astype(np.uint8), "codes": codes,
        "ids": np.arange(words, dtype=np.uint32), "counts": counts,
    }
    row = {"chunk": 0} | {k: pack(x) for k, x in arrays.items()}
    c = suffixtree._Chunk(row, parts, n, words, 1)
    for level in (2, 3, 4):
        suffix_tree_level(c, parts)
        c.open_level()
        state = c.state()
        assert len(c.at) > 1000
        if level == 2:
            assert sum(map(len, state)) < 9 * len(c.item)  # two probabilities alone were 16 bytes an item
        again = suffixtree._Chunk(row | {"state": state}, parts, n, words, level)
        for name in ("suffix_p", "best", "item", "context", "alone", "context_alone", "score"):
            assert (getattr(again, name) == getattr(c, name)).all(), name
        assert len(again.codes) <= len(c.codes) and (again.ids[again.codes[again.at]] == c.ids[c.codes[c.at]]).all()
        for name in ("asked_items", "asked_contexts"):
            for x, y in zip(getattr(again, name)()[1], getattr(c, name)()[1]):
                assert (x == y).all()
        c = again


def test_chat_round_trip(spark):
    rng = random.Random(6)
    rows = [(-7, t, r, "\\### Assistant: </turn> ok") for t, r in enumerate(("user", "assistant"))]
    for c in range(30):
        for t in range(rng.randint(1, 60)):
            role = rng.choice(["user", "assistant", "system", None, "a: b\n#", ""])
            words = [rng.choice(["word", "###", "</turn>\n", "\\", "\\h", "é", ": ", "\n", "<"]) for _ in range(rng.randint(0, 200))]
            rows.append((c, t, role, rng.choice([" ".join(words), None, ""])))
    rows += [(None, None, "user", "x"), (None, 1, "assistant", "y"), (3, 0, "user", "again"), (3, 0, "user", "again")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("span", F.lit(0)).withColumn("pos", F.lit(0))
    windows = chat.format_windows(df)
    talks = defaultdict(list)
    for c, t, r, x in rows:
        talks[c].append((t is not None, t or 0, r or "", x or ""))
    got = {r.conv_id: r for r in chat.digest_conversations(windows).collect()}
    assert set(got) == set(talks)
    for c, turns in talks.items():
        turns.sort()
        said = "".join(f"{r}\n{x}\n" for *_, r, x in turns)
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        g = got[c]
        assert (g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256) == (
            len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()
        )
    assert chat.format_windows(df.where("false")).count() == 0
    plain = windows.where("window > 1").first()
    assert plain.repeated > 0


def test_chat_uses_no_python(spark):
    from tests.test_oracle import plan

    text = plan(QUERIES["op7_budgeted_chat"](spark, SF))
    assert not re.search("Python|Pandas|Arrow", text)


def test_chat_keeps_the_budget(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = chat.format_windows(df, budget=300, history_tokens=60).select("tokens", "repeated", "n_turns").collect()
    assert all(r.tokens <= 300 or r.n_turns - r.repeated == 1 for r in rows)


def test_warc_odd_payloads(spark, tmp_path):
    rows = [
        (5, "http://a/\r\nX: y", "dup"), (2, None, "dup"), (9, "http://b", None), (10, "http://b", ""),
        (11, "u", "x\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\n\r\n"), (None, "u", "dup"), (None, "u", "lone"),
        (12, "u", "é" * 40_000), (2, "v", "dup"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha", F.lit(1))
    for least, path in ((0, f"{tmp_path}/a"), (4, f"{tmp_path}/b")):
        warc.write_archives(df, path, min_bytes=least)
        captures = land(warc.assemble(warc.read_records(spark, path)), "captures")
        got = warc.resolve_revisits(captures).collect()
        groups = defaultdict(list)
        for i, _, html in rows:
            groups[html or ""].append(i)
        want = []
        for html, ids in groups.items():
            data = html.encode()
            first = min((i for i in ids if i is not None), default=None)
            for i in ids:
                again = len(data) >= least and first is not None and i != first
                want.append((i, len(data), warc.payload_digest(data), "revisit" if again else "response", first if again else None))
        assert Counter(map(tuple, got)) == Counter(want)
        full = captures.where("response.type = 'response'").select("response.payload", "requests", "metadata").collect()
        assert all(len(r.requests) >= 1 and len(r.metadata) >= 1 for r in full)
        assert {bytes(r.payload).decode() for r in full} == set(groups)
    warc.write_archives(df.where("false"), f"{tmp_path}/c")
    assert warc.assemble(warc.read_records(spark, f"{tmp_path}/c")).count() == 0


def test_pipeline_against_plain_steps(spark, docs):
    rows = corpus_pipeline.run(spark, SF).collect()
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_duplicates", "personal_data", "packing"]
    spoken = {r.doc_id: r.text for r in docs.collect() if any(c.isalpha() for c in r.text or "")}
    prints = {i: plain_fingerprint(t) for i, t in spoken.items()}
    near = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    first = plain_components(prints, near)
    kept = {i: t for i, t in spoken.items() if first[i] == i}
    clean, lines = {}, plain_disclosed(kept.items())
    for i, t in kept.items():
        at, parts = 0, []
        for a, b, k in pii.read_spans(lines[i]):
            if a >= at:
                parts += [t[at:a], "" if k == 5 else f"[{(pii.KINDS + pii.ADDED)[k].upper()}]"]
            at = max(at, b)
        clean[i] = "".join(parts) + t[at:]
    check_packing(rows, clean.items())


def test_pipeline_of_odd_rows(spark, odd):
    frame = odd.select("doc_id", "text", "lang", F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    for _, stage in corpus_pipeline.STAGES:
        frame = land(stage(spark, frame, SF), "stage")
    assert {r.doc_id for r in frame.collect()} == {None, 3, 5, 7, 8}


def test_fold(spark):
    df = spark.range(50).withColumnRenamed("id", "doc_id").withColumn("f", fold(7))
    assert all(r.f == zlib.crc32(str(r.doc_id).encode()) % 7 for r in df.collect())
