"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from sievework.plans import queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
# Queries that SQL doesn't express, and the module that tests them by brute force or on rows worked out by hand.
PROVEN = {
    "title_linkage_full": "test_brute", "title_linkage_cut": "test_brute", "title_recovery_ranking": "test_brute", "title_recovery_strict": "test_brute", "title_simple_ranking": "test_brute",
    "output_names": "test_brute", "seeded_sample": "test_brute", "abstract_coverage": "test_rules", "title_reconciliation": "test_rules", "title_variants": "test_rules", "file_identity_verdicts": "test_rules",
}
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, duck, name):
    df = queries.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    if (sql := queries.oracle_sql().get(name)) is None:
        assert name in PROVEN and columns
        return
    cursor = duck.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in cursor.fetchall()), key=str)
