"""Runs a query and its SQL over the same tables."""

import os

import duckdb


def rows_of(names, rows):
    plain = lambda v: float(v) if hasattr(v, "__float__") and not isinstance(v, (bool, str)) else v
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=str)


def check(spark, query, sql, data):
    db = duckdb.connect()
    for f in os.listdir(data):
        db.execute(f"create view {f.split('.')[0]} as select * from '{data}/{f}'")
    got, want = query(spark, data), db.sql(sql)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(want.columns, want.fetchall())
