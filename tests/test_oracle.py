"""Every registered query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from mixloom.catalog.registry import ORACLES
from tools.check_oracle import TABLES, canonical

#: queries that another subpackage added
TEXT = {n for n in entry.queries() if n == "pipeline" or n.startswith("op")}
SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no benchmark tables")


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return connection


KINDS = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
}


#: the queries of the core; other subpackages test their own
CORE = sorted(set(ORACLES) & set(entry.queries()) - TEXT)


@pytest.mark.parametrize("name", CORE)
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, SF_DIR)
    relation = con.sql(entry.oracle_sql()[name])
    assert {c: KINDS[t] for c, t in df.dtypes} == dict(
        zip(relation.columns, map(str, relation.types))
    )
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    want = canonical(relation.columns, relation.fetchall())
    assert got[1] and got == want


def test_every_query_has_sql():
    # the whole mini-batch job takes minutes in SQL; test_trainers holds it against arrays
    assert set(CORE) | {"m06_sgd_fit", "m07_kmeans_seeds"} == set(entry.queries()) - TEXT


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert [r["rank"] for r in rows] == list(range(7))
    assert sum(r.weight for r in rows) == pytest.approx(1, abs=1e-5)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name", ["p09_augment", "m09_posteriors", "m10_labels", "p04_minmax_scale", "m02_log_density"]
)
def test_row_wise_queries_do_not_shuffle(spark, name):
    text = plan(entry.queries()[name](spark, SF_DIR))
    assert "Exchange" not in text and "Python" not in text and "Join" not in text


@pytest.mark.parametrize("name", ["a03_category_stats", "a05_class_means", "a12_hist2d", "a14_coverage"])
def test_groups_are_summed_before_they_are_shuffled(spark, name):
    text = plan(entry.queries()[name](spark, SF_DIR))
    assert "partial_" in text and "Cartesian" not in text and "NestedLoop" not in text


def test_scan_reads_only_what_is_needed(spark):
    df = entry.queries()["a05_class_means"](spark, SF_DIR)
    scans = [line for line in plan(df).splitlines() if "FileScan" in line]
    line = next(s for s in scans if "l_tax" in s)
    assert "l_extendedprice" not in line and "l_shipdate" not in line
