import duckdb
import pytest

from libris.plans.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", list(QUERIES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    rel = con.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(rel.columns)
    mine = sorted(repr(tuple(r[c] for c in sorted(df.columns))) for r in df.collect())
    names = rel.columns
    theirs = sorted(repr(tuple(r[names.index(c)] for c in sorted(names))) for r in rel.fetchall())
    assert mine == theirs


def test_entry_without_the_other_parts():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(ORACLE) <= set(e.oracle_sql())
