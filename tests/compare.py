"""A query's rows against those of its SQL."""

import glob
import os

import duckdb


def tables(sf):
    db = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return db


def plain(rows):
    return sorted(tuple(repr(round(x, 9)) if isinstance(x, float) else repr(x) for x in r) for r in rows)


def same_rows(df, db, sql):
    columns = sorted(df.columns)
    got = db.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == columns
    theirs = plain(tuple(r[names.index(c)] for c in columns) for r in got.fetchall())
    ours = plain(tuple(r[c] for c in columns) for r in df.collect())
    assert ours == theirs
    return len(ours)
