"""Vector operators against brute force."""

from collections import Counter

import duckdb
import numpy as np
import pytest

from mixloom.llm import ann, forest
from mixloom.llm.queries import ORACLES, QUERIES
from tests.test_oracle import TABLES, canonical

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    rel = con.sql(ORACLES[name])
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical(rel.columns, rel.fetchall())


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, rep int, cell int").repartition(3)


ODD = [
    (1, None, 0, 0), (2, [0.0] * 8, 0, 0), (3, [float("nan")] + [1.0] * 7, 0, 0), (None, [1.0] * 8, 0, 0),
    (5, [float("inf")] * 8, 0, 0), (6, [1.0, None] + [1.0] * 6, 0, 0), (7, [1.0] * 3, 0, 0), (8, [], 0, 0),
]


def clustered(rng, d=8):
    """Lone vectors, tight groups, one dense ball and many equal ones."""
    lone = rng.standard_normal((120, d))
    tight = np.repeat(rng.standard_normal((15, d)), 4, axis=0) + 0.05 * rng.standard_normal((60, d))
    ball = rng.standard_normal(d) * 2 + 0.05 * rng.standard_normal((150, d))
    wide = rng.standard_normal(d) * 2 + 0.35 * rng.standard_normal((60, d))
    same = np.repeat(rng.standard_normal((1, d)), 80, axis=0)
    rows = np.concatenate([lone, tight, ball, wide, same])
    rows[5] = 3 * rows[4]
    return rows[rng.permutation(len(rows))]


@pytest.mark.parametrize("leaf_rows", [20, 100, 5000])
def test_forest_finds_all_links(spark, leaf_rows, monkeypatch):
    monkeypatch.setattr(forest, "BALL_SHARE", 1 / 50)
    vectors = clustered(np.random.default_rng(8))
    rows = [(100 + i, v.tolist(), 0, 0) for i, v in enumerate(vectors)]
    got = forest.near_duplicate_vectors(frame(spark, rows + ODD), leaf_rows=leaf_rows, trees=12, margin=0.1).collect()
    assert len(got) == len(rows) + len(ODD)
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    label = np.arange(len(rows))
    while True:
        new = np.minimum(label, np.where(near, label[None, :], len(rows)).min(1))
        if (new == label).all():
            break
        label = new
    found = {r.vec_id: r for r in got if r.vec_id is not None and r.vec_id >= 100}
    assert {i: found[100 + i].n_links for i in range(len(rows))} == dict(enumerate(near.sum(1).tolist()))
    assert all(found[100 + i].component_id == 100 + label[i] for i in range(len(rows)))
    for r in got:
        assert r.kept == (r.vec_id is not None and r.vec_id == r.component_id)
        if r.vec_id is None or r.vec_id < 100:
            assert r.n_links == 0 and r.component_id == r.vec_id


def test_forest_of_nothing(spark):
    assert forest.near_duplicate_vectors(frame(spark, ODD).where("false")).count() == 0
    assert {r.n_links for r in forest.near_duplicate_vectors(frame(spark, ODD[:1])).collect()} == {0}


def test_search_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ann, "STRIPE", 100)
    monkeypatch.setattr(ann, "BLOCK", 64)
    monkeypatch.setattr(ann, "LEAST_QUERIES", 4)
    vectors = clustered(np.random.default_rng(9))
    rows = [(100 + i, v.tolist(), 0, 0) for i, v in enumerate(vectors)]
    df = frame(spark, rows + ODD)
    got = ann.search(df, df.where("vec_id % 20 = 0"), k=20).collect()
    hits = total = 0
    for q in range(0, len(rows), 20):
        own = sorted((r for r in got if r.query_id == 100 + q), key=lambda r: r.rank)
        scores = ann.exact_products(vectors, np.repeat(vectors[q : q + 1], len(vectors), 0))
        want = [i for i in np.lexsort((np.arange(len(rows)), -scores)) if i != q][:20]
        assert [r.rank for r in own] == list(range(1, 21))
        assert all(r.score == scores[r.vec_id - 100] for r in own)
        assert own == sorted(own, key=lambda r: (-r.score, r.vec_id))
        hits += len({r.vec_id - 100 for r in own} & set(want))
        total += 20
    assert hits / total >= 0.97


def test_search_small_and_repeated(spark):
    few = [(i, [float(i), 1.0], 0, 0) for i in (20, 40, 40, 3)]
    df = frame(spark, few)
    got = ann.search(df, df.where("vec_id = 20")).collect()
    assert [(r.rank, r.vec_id, r.score) for r in sorted(got)] == [(1, 40, 801.0), (2, 40, 801.0), (3, 3, 61.0)]
    assert ann.search(df.where("false"), df.where("false")).count() == 0
    assert ann.search(df, df.where("false")).count() == 0
    assert Counter(r.query_id for r in ann.search(df, df).collect()) == {20: 3, 3: 3, 40: 4}
