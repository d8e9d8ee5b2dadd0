"""Every query with SQL gives the same rows in DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, canon

ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(name, spark, duck, sf_dir):
    df = entry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(tuple(canon(v) for v in r) for r in df.select(*columns).collect())
    cur = duck.execute(ORACLES[name])
    have = [d[0] for d in cur.description]
    assert sorted(have) == columns
    index = [have.index(c) for c in columns]
    want = sorted(tuple(canon(r[i]) for i in index) for r in cur.fetchall())
    assert got == want


@pytest.mark.parametrize("name,rows", [("dim_correlation_summary", 4000), ("dim_label_corr_summary", 0)])
def test_nothing_to_list(name, rows, spark, tmp_path):
    """No pair of dimensions above the threshold, and no dimension at all: string_agg gives NULL."""
    duck = duckdb.connect()
    vectors = "list_transform(range(64), lambda d: CAST(hash(i * 64 + d) % 1000003 / 1000003.0E0 - 0.5E0 AS FLOAT))"
    duck.execute(f"CREATE TABLE embeddings AS SELECT i AS vec_id, {vectors} AS embedding, 0 AS label FROM range({rows}) t(i)")
    duck.execute(f"COPY embeddings TO '{tmp_path}/embeddings.parquet'")
    df = entry.queries()[name](spark, str(tmp_path))
    cur = duck.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLES[name]})")
    assert [tuple(map(canon, r)) for r in df.collect()] == [tuple(map(canon, r)) for r in cur.fetchall()]


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and {"note_id", "ctr", "ces_rate", "impression_log"} <= set(df.columns)
