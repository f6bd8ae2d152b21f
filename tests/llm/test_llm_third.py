"""Packing by histogram, whitening and spelling variants against plain versions, and odd rows."""

import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mixloom.llm import spfhp, variants, whitening
from mixloom.llm.common import land
from mixloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_50k.json")


# packing


def plain_packs(lengths, cap):
    """Pieces (length, start, size) with one pack and one document at a time."""
    wanted, rest = divmod(sum(n for n in lengths if n < cap), cap)
    out = Counter((cap, 0, cap) for n in lengths if n == cap)
    rooms = [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]
    todo, packs, used = defaultdict(list), [], 0
    for n in lengths:
        if n < cap:
            todo[n].append((n, 0))
    for size in range(cap - 1, 0, -1):
        for length, start in todo.pop(size, []):
            best = min((i for i, u in enumerate(packs) if u < cap), key=packs.__getitem__, default=None)
            if best is not None and packs[best] + size <= cap:
                packs[best] += size
                out[length, start, size] += 1
            elif len(packs) < wanted:
                packs.append(size)
                out[length, start, size] += 1
            elif best is not None:
                room, packs[best] = cap - packs[best], cap
                out[length, start, room] += 1
                todo[size - room].append((length, start + room))
            else:
                at, left = start, size
                while left:
                    step = min(left, rooms[0] - used)
                    out[length, at, step] += 1
                    at, left, used = at + step, left - step, used + step
                    if used == rooms[0]:
                        rooms.pop(0)
                        used = 0
    assert not rooms and all(u == cap for u in packs)
    return out


def planned_packs(lengths, cap):
    plan, sequences = spfhp.plan_packs(dict(Counter(lengths)), cap)
    out, held = Counter(), defaultdict(list)
    for n, count in Counter(lengths).items():
        rank, at = np.arange(count), np.zeros(count, np.int64)
        while len(rank):
            size, sequence, offset = plan.places(np.full(len(rank), n), at, rank)
            for a, b, q, o in zip(at.tolist(), size.tolist(), sequence.tolist(), offset.tolist()):
                out[n, a, b] += 1
                held[q].append((o, b))
            at = at + size
            rank, at = rank[at < n], at[at < n]
    assert len(held) == sequences
    return out, held


def check_sequences(held, cap):
    """Gapless, full but for different powers of two."""
    short = []
    for places in held.values():
        end = 0
        for offset, size in sorted(places):
            assert offset == end
            end += size
        assert end <= cap
        if end < cap:
            short.append(end)
    assert all(n & (n - 1) == 0 for n in short) and len(set(short)) == len(short)


def test_plan_equals_one_document_at_a_time():
    rng = random.Random(1)
    for trial in range(300):
        cap = rng.choice([8, 10, 16, 64, 256])
        draw = [
            lambda: rng.randint(1, cap), lambda: rng.choice([1, 2, 3]), lambda: rng.choice([cap // 2 + 1, cap - 1]),
            lambda: min(cap, 1 + int(rng.expovariate(6 / cap))),
        ][trial % 4]
        lengths = [draw() for _ in range(rng.randint(0, 60))]
        got, held = planned_packs(lengths, cap)
        assert got == plain_packs(lengths, cap)
        check_sequences(held, cap)


def test_plan_does_not_grow_with_documents():
    rng = np.random.default_rng(2)
    few = Counter(np.minimum(1024, 1 + rng.exponential(150, 20_000).astype(int)).tolist())
    small, _ = spfhp.plan_packs(dict(few))
    large, sequences = spfhp.plan_packs({n: 100_000 * c for n, c in few.items()})
    assert len(large.keys) < 2 * len(small.keys)
    assert sequences <= sum(100_000 * n * c for n, c in few.items()) // 1024 + 11
    spfhp.plan_packs({})


def check_pieces(rows, docs):
    """Every id in one piece, right sums, whole sequences."""
    coder, left, held = Tokenizer.from_file(BPE), Counter(), defaultdict(list)
    for i, text in docs:
        ids = np.array(coder.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        left[i, ids.tobytes()] += 1
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        held[r.sequence_id].append((r.offset, r.length))
    check_sequences(held, 1024)
    tokens = {i: Counter() for i, _ in docs}
    for (i, data), many in left.items():
        ids = np.frombuffer(data, "<u4")
        tokens[i][len(ids)] += many * len(ids)
        fits = [
            r for r in by_doc[i]
            if r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        ]
        cover = Counter(k for r in fits for k in range(r.start, r.start + r.length))
        assert all(cover[k] == many for k in range(len(ids)))
    assert sum(r.length for r in rows) == sum(sum(t.values()) for t in tokens.values())
    assert len({(s, o) for s, p in held.items() for o, _ in p}) == len(rows)


def test_packing_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    check_pieces(QUERIES["op13_shortest_pack_histogram"](spark, SF).collect(), [tuple(r) for r in docs])


@pytest.mark.parametrize("rows", [spfhp.BROADCAST_ROWS, 0])
def test_packing_odd_rows(spark, monkeypatch, rows):
    monkeypatch.setattr(spfhp, "BROADCAST_ROWS", rows)
    docs = [
        (1, None), (2, ""), (3, "the same words"), (3, "the same words"), (None, "without an id"), (None, None),
        (4, " \n\t"), (5, "x" * 70_000 + " é"), (7, "Ünï <|endoftext|> ok"), (8, "a b " * 20_000),
        *((100 + k, "word " * (k % 700)) for k in range(300)),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    clash = ["start", "length", "ids", "part", "nth", "rank", "n", "before", "offset", "Sequence_ID"]
    df = land(df.repartition(5).withColumns({c: F.lit(1) for c in clash}), "odd")
    got = spfhp.pack_histogram(df, BPE)
    check_pieces(got.collect(), docs)
    assert spfhp.pack_histogram(df.where("false"), BPE).count() == 0
    assert spfhp.pack_histogram(df.where("doc_id = 2"), BPE).drop("ids_crc32").collect() == [(2, 0, 1, 1, 0, 0)]


# whitening


def plain_scatter(x):
    n, s = len(x), x.sum(0)
    return n, s, n * (x.T @ x) - np.outer(s, s)


def whole(rows):
    return np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in r] for r in rows], object)


def check_whitening(model, x, many):
    """Against LAPACK on the exactly centred list of different vectors."""
    x = np.array(sorted({tuple(r) for r in x}), object)
    n, sums, matrix = plain_scatter(x)
    assert model.n == n and [s + 1_000_000 * n for s in model.sums] == sums.tolist()
    cov = np.array([[float(Fraction(int(v), n * n)) for v in r] for r in matrix])
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:many], vectors[:, ::-1][:, :many]
    assert len(model.eigenvalues) == many
    assert np.allclose(model.eigenvalues, values, rtol=1e-10)
    assert np.allclose(model.explained, values / np.trace(cov), rtol=1e-10)
    own = model.components
    assert np.allclose(own.T @ own, np.eye(many), atol=1e-14)
    assert np.allclose(cov @ own, own * values, atol=1e-11 * values[0])
    assert model.identity_error < 1e-10
    return n, sums, own


def test_whitening_query(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    x = whole([r.embedding for r in rows])
    model = whitening.fit_whitening(spark.read.parquet(f"{SF}/embeddings.parquet"))
    n, sums, own = check_whitening(model, x, 16)
    got = QUERIES["op11_polynomial_whitening"](spark, SF).collect()
    assert len(got) == 16 * len(rows)
    want = {}
    for r, v in zip(rows, x):
        centred = n * v - sums
        want[r.vec_id] = (sum(c * c for c in centred), (centred / n).astype(float) @ own / np.sqrt(model.eigenvalues))
    for r in got:
        deviation, y = want[r.vec_id]
        assert r.deviation == deviation and abs(r.whitened - y[r.component - 1]) < 1e-9
        assert r.n == n and r.explained == model.explained[r.component - 1] and r.identity_error < 1e-4


def test_whitening_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 1.0, 0.0]), (1, [0.5, 1.0, 0.0]), (2, None), (3, [1.0, None, 2.0]), (4, [nan, 0.0, 0.0]),
            (5, [inf, 0.0, 1.0]), (6, []), (7, [1e300, 0.0, 0.0]), (None, [3.0, -1.0, 0.0]), (8, [-2.0, 5.0, 0.0]),
            (9, [0.5, 1.0, 0.0]), (10, [0.0, 0.25, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    df = land(df.withColumns({c: F.lit(1) for c in ("x", "X_", "Deviation", "whitened", "n")}), "odd")
    fine = [r for r in rows if r[0] in (1, None, 8, 9, 10)]
    model = whitening.fit_whitening(df)
    check_whitening(model, whole([r[1] for r in fine]), 2)  # the third axis is constant: rank 2
    out = whitening.whiten(df, model)
    assert out.columns == ["vec_id", "x", "X_", "n", "deviation", "whitened"]
    assert Counter(r.vec_id for r in out.collect()) == Counter(r[0] for r in fine)
    none = whitening.fit_whitening(df.where("false"))
    assert (none.n, none.eigenvalues) == (0, []) and whitening.whiten(df.where("false"), none).count() == 0
    one = whitening.fit_whitening(df.where("vec_id IN (1, 9)"))
    assert one.n == 1 and one.eigenvalues == []
    assert [tuple(r) for r in whitening.whiten(df.where("vec_id = 1"), one, carry=["vec_id"]).collect()] == [(1, 0, [])] * 2
    with pytest.raises(ValueError, match="entries"):
        whitening.fit_whitening(spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "embedding array<double>"))


def test_whitening_of_equal_variances_and_large_numbers(spark):
    # the corners of a cross: two equal eigenvalues, and one of its own
    rows = [([s * 4.0 if i == k else 0.0 for i in range(2)] + [0.0],) for k in range(2) for s in (1, -1)]
    rows += [([0.0, 0.0, s * 50.0],) for s in (1, -1)]
    model = whitening.fit_whitening(spark.createDataFrame(rows, "embedding array<double>"))
    check_whitening(model, whole([r[0] for r in rows]), 3)
    assert model.eigenvalues[1] == model.eigenvalues[2]
    # products beyond a long: sums stay exact, deviations are null
    rng = np.random.default_rng(4)
    rows = [([float(v) for v in rng.integers(-(1 << 50), 1 << 50, 3)],) for _ in range(40)]
    df = spark.createDataFrame(rows, "embedding array<double>")
    model = whitening.fit_whitening(df)
    check_whitening(model, whole([r[0] for r in rows]), 3)
    assert {r.deviation for r in whitening.whiten(df, model).collect()} == {None}


def test_characteristic_polynomial_and_roots(spark):
    rng = np.random.default_rng(5)
    b = rng.integers(-9, 9, (5, 8)).astype(object)
    matrix = b @ b.T
    poly = whitening.characteristic_polynomial(spark, matrix.tolist())
    power, want = np.eye(5, dtype=int).astype(object), [1]
    for k in range(1, 6):  # the exact recurrence over traces
        product = matrix @ power
        want.append(-sum(product[i, i] for i in range(5)) // k)
        power = product + want[-1] * np.eye(5, dtype=int).astype(object)
    assert poly == want[::-1]
    poly = np.array([1], object)
    for root in (7, 7, 7, 5, 5, 2, 1, 8):
        poly = np.convolve(poly, np.array([-root, 1], object))
    found = [whitening.isolate_root(list(poly), k) for k in range(1, 9)]
    assert [m for *_, m in found] == [1, 3, 3, 3, 2, 2, 1, 1]
    for (low, bits, _), root in zip(found, (8, 7, 7, 7, 5, 5, 2, 1)):
        assert low < root * 2**bits <= low + 1


# spelling variants


def plain_words(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def plain_variants(words):
    """Near words by what is left when one letter goes, or is masked."""
    masks, near = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            masks[w[:i] + "\0" + w[i + 1 :]].add(w)
    for own in masks.values():
        for w in own:
            near[w] |= own - {w}
    for w in words:
        for i in range(len(w)):
            shorter = w[:i] + w[i + 1 :]
            if shorter in words:
                near[w].add(shorter)
                near[shorter].add(w)
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= 5 * words[w]:
            form[w] = best
    rows = set()
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        rows.add((w, form.get(w), root, n, len(near[w]), words.get(form.get(w))))
    return rows


def test_variants_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op12_partenum_variants"](spark, SF).collect()
    assert {tuple(r) for r in got} == plain_variants(plain_words(docs)) and len(got) > 500
    assert sum(r.form is not None for r in got) > 10


def test_variants_follow_chains_and_odd_rows(spark):
    rng = random.Random(6)
    said = {"kitten": 1, "kittens": 6, "mittens": 30, "mitten": 200, "smitten": 5, "Ärgerlich": 5, "ärgerlich": 30,
            "x" * 3000: 5, "x" * 3001: 26, "aaaaaa": 9, "aaaaab": 9, "baaaaa": 9, "÷×÷×÷×": 7, "short": 90}
    for _ in range(400):
        said["".join(rng.choice("abcé") for _ in range(rng.randint(6, 9)))] = rng.randint(3, 60)
    text = " ".join(w for w, n in said.items() for _ in range(n))
    rows = [(None, None), (1, ""), (2, " \n"), (None, "kitten KITTEN Kitten"), (3, "kitten"), (3, "kitten"), (4, text)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df = land(df.withColumns({c: F.lit(1) for c in ("word", "id", "run", "h", "N", "near")}), "odd")
    words = land(variants.count_words(df, spoil=F.col("doc_id")), "words")
    got = {tuple(r) for r in variants.group_variants(words).collect()}
    assert got == plain_variants(plain_words(rows))
    assert any(r[1] is not None and r[1] != r[2] for r in got)  # a chain of two steps
    empty = land(variants.count_words(df.where("false")), "words")
    assert variants.group_variants(empty).count() == 0
    plain = {r.word: r.n for r in variants.count_words(df).collect()}
    assert plain["mitten"] == 200 and "short" not in plain


@pytest.mark.parametrize("level, one_longer", [((1, 6), (1, 4)), ((2, 4), (1, 3)), ((3, 2), (2, 2))])
def test_any_scheme_is_exact(spark, level, one_longer):
    rng = random.Random(7)
    words = {"".join(rng.choice("abcd") for _ in range(rng.randint(6, 8))): rng.randint(5, 50) for _ in range(600)}
    table = land(spark.createDataFrame(list(words.items()), "word string, n long"), "words")
    got = Counter((r.word, r.near) for r in variants.near_words(table, level, one_longer).collect())
    want = set()
    for a in words:
        for b in words:
            if len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1:
                want.add((a, b))
            if len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a))):
                want |= {(a, b), (b, a)}
    assert set(got) == want and set(got.values()) == {1}
