import hashlib
import math

import numpy as np
import pytest
from compare import check

from quadrant.llm import codes
from quadrant.llm.registry import oracle_sql, queries

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows):
    """Lloyd's rounds over Python integers."""
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    d = len(kept[0][1]) // 4
    parts = [[v[p * d : p * d + d] for p in range(4)] for _, v, _ in kept]
    books = [[parts[i][p] for i in range(min(256, len(kept)))] for p in range(4)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda p, x: min((dist(x, c), k) for k, c in enumerate(books[p]))
    for _ in range(4):
        found = [[nearest(p, x)[1] for p, x in enumerate(ps)] for ps in parts]
        for p in range(4):
            for k in range(len(books[p])):
                mine = [ps[p] for ps, f in zip(parts, found, strict=True) if f[p] == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    last = [[nearest(p, x) for p, x in enumerate(ps)] for ps in parts]
    errors = [sum(x for x, _ in f) for f in last]
    totals = {}
    for (_, _, label), e in zip(kept, errors, strict=True):
        totals[label] = totals.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{k:02x}" for _, k in f), e, totals[label], digest) for (i, _, label), f, e in zip(kept, last, errors, strict=True)), key=str)


def rows_of(df):
    return sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def mixed():
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(0, 0.05, 8).tolist(), int(k % 3) if k % 7 else None) for k in range(400)]
    rows += [(500 + k, [0.25, -0.25, 0.125, 0.5] * 2, 1) for k in range(20)] + [rows[5], rows[5], (None, [0.01] * 8, 2), (600, None, 1), (601, [0.1] * 7 + [None], 1), (602, [float("nan")] * 8, 1), (603, [0.1] * 7 + [float("-inf")], None)]
    return rows


@pytest.mark.parametrize("name", ["sf0.001", "sf0.1"])
def test_codes_equal_sql(spark, name):
    check(spark, queries()["op13_codes"], oracle_sql()["op13_codes"], f"/root/testdata/{name}")


def test_codes_equal_brute_force(spark, mixed, monkeypatch):
    df = spark.createDataFrame(mixed, SCHEMA).selectExpr("*", "1 AS code", "'x' AS error", "2 AS v", "3 AS part", "4 AS n").repartition(5)
    want = brute(mixed)
    assert rows_of(codes.compress(df)) == want
    monkeypatch.setattr(codes, "MOST_LABELS", 0)
    assert rows_of(codes.compress(df)) == want


def test_few_equal_and_large_vectors(spark):
    for rows in ([(k, [float(k % 2)] * 4, None) for k in range(6)], [(k, [2.0**17 * (k % 5), -(2.0**16), 1e-9 * k, -1e-9 * k], k) for k in range(20)], [(k, [1000.0 * (-1) ** k] * 4 + [float(k)] * 4, 0) for k in range(300)]):
        assert rows_of(codes.compress(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_nothing_and_vectors_that_do_not_fit(spark):
    empty = spark.createDataFrame([(1, None, 1)], SCHEMA)
    assert codes.compress(empty).collect() == [] and codes.compress(empty.limit(0)).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    for bad in ([(1, [1.0] * 5, 0)], [(1, [1.0] * 4, 0), (2, [1.0] * 8, 0)], [(1, [], 0)], [(1, [1e300] * 4, 0)]):
        with pytest.raises(ValueError):
            codes.compress(spark.createDataFrame(bad, SCHEMA))


def test_bounds_spare_scans_and_change_nothing():
    rng = np.random.default_rng(1)
    centers = rng.integers(-4000, 4000, (40, 6))
    x = centers[rng.integers(0, 40, 5000)] + rng.integers(-300, 300, (5000, 6))
    book = codes.Codebook(x[:40])
    code, upper, lower = book.scan(x)
    scanned = []
    for _ in range(6):
        means = np.array([x[code == k].sum(0) // max(1, (code == k).sum()) if (code == k).any() else book.entries[k] for k in range(40)])
        book = codes.Codebook(means, book.entries)
        code, upper, lower, n = book.assign(x, code, upper, lower)
        scanned.append(n)
        d = ((x[:, None] - means[None]) ** 2).sum(2)
        assert (code == d.argmin(1)).all()  # argmin takes the first of equals
        own = np.sqrt(d[np.arange(5000), code])
        d[np.arange(5000), code] = 1 << 60
        assert (upper >= own).all() and (lower <= np.sqrt(d.min(1))).all()
    assert scanned[-1] < 2500
