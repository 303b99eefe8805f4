"""Every registered query with SQL, against DuckDB on the same tables."""

import glob
import math
import os

import duckdb
import pytest

from framewright import queries as Q


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.12g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = Q.QUERIES[name](spark, sf_dir)
    rows = df.collect()
    if name not in Q.ORACLE_SQL:
        assert rows
        return
    want = duck.sql(Q.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    names = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in names) for r in rows)
    assert got == sorted(tuple(map(plain, r)) for r in want.select(*[f'"{c}"' for c in names]).fetchall())


def test_reorder_gives_each_packet_once(spark, sf_dir):
    rows = Q.QUERIES["reorder_emit"](spark, sf_dir).collect()
    by = {}
    for r in rows:
        by.setdefault(r.stream_key, []).append(r.rtp_seq)
    assert all(len(set(s)) == len(s) for s in by.values())
    assert len(rows) == Q._shuffled(Q.frames(spark, sf_dir)).count()
