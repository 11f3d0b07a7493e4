"""Runs a query and its SQL side by side."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _key(row):
    return tuple("" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v) for v in row)


def same(df, sql: str, sf_dir: str) -> int:
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    expected = sorted(_key(r) for r in want.fetchall())
    got = sorted(_key(r[n] for n in names) for r in df.collect())
    assert len(got) == len(expected)
    assert got == expected, next((g, e) for g, e in zip(got, expected) if g != e)
    return len(got)
