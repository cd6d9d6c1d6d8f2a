"""D-optimal selection: k locations whose features span the largest volume.

The state of a selection is a matrix of features by features on the driver; what depends on the number of locations is an
aggregate over them. "greedy" picks locations by largest leverage and is independent of row order but for ties, which the
smaller loc_id wins. As leverages only fall while locations are chosen, one pass that returns the BATCH largest serves as
many picks as stay above the least of them, so the picks are those of a pass each. "coresets" makes such picks in every
part of the table at once and then among the picked: one pass, whatever k. "pivot" starts from the first k rows and
exchanges one location at a time by a pivot step.
"""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from quadrant.functions.rng import order_key
from quadrant.operators.samplers import Samples
from quadrant.operators.spacing import spaced
from quadrant.sources.shared import written

#: Rows that a pass of "greedy" returns; rows of a part of "coresets".
BATCH, PART = 512, 20_000
RIDGE = 1e-9


def numeric_features(df: DataFrame, but: tuple[str, ...] = ("loc_id", "x", "y")) -> list[str]:
    """Every numeric column but the key and the coordinates."""
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType) and f.name not in but]


def normalize(df: DataFrame, features: list[str]) -> DataFrame:
    """Features less their mean, by their sample standard deviation; constant ones are only centred."""
    stats = df.agg(*[F.avg(c).alias(f"m_{k}") for k, c in enumerate(features)], *[F.stddev_samp(c).alias(f"s_{k}") for k, c in enumerate(features)]).first()
    out = df
    for k, c in enumerate(features):
        sd = stats[f"s_{k}"] or 1.0
        out = out.withColumn(c, (F.col(c) - F.lit(stats[f"m_{k}"])) / F.lit(sd))
    return out


def excluded(points: DataFrame, chosen: list[tuple[float, float]], min_dist: float) -> Column:
    """Whether a row of points (x, y) is nearer than min_dist to a chosen point."""
    table = F.array(*[F.struct(F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for a, b in chosen])
    near = lambda c: (F.col("x") - c["a"]) * (F.col("x") - c["a"]) + (F.col("y") - c["b"]) * (F.col("y") - c["b"]) < F.lit(float(min_dist) ** 2)
    return F.exists(table, near)


def leverage(matrix: np.ndarray, f: str = "f") -> Column:
    """f M f' of an array column and a matrix of numbers, which multiplies det(S'S) by 1 + leverage if M is its inverse."""
    rows = F.lit([[float(x) for x in row] for row in matrix])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return dot(F.col(f), F.transform(rows, lambda row: dot(row, F.col(f))))


def projection_top(matrix: np.ndarray, f: str = "f") -> Column:
    """The largest absolute component of the vector f W, W a matrix of numbers with a row a feature."""
    columns = F.lit([[float(x) for x in column] for column in np.transpose(matrix)])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.array_max(F.transform(columns, lambda column: F.abs(dot(column, F.col(f)))))


def gram(rows: DataFrame, n: int, f: str = "f") -> DataFrame:
    """i, j, value: sums of products of the i-th and the j-th feature, i <= j, from 1; one aggregate of a row."""
    pairs = [(i, j) for i in range(1, n + 1) for j in range(i, n + 1)]
    one = rows.agg(F.array(*[F.sum(F.element_at(f, i) * F.element_at(f, j)) for i, j in pairs]).alias("v"))
    at = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in pairs])
    return one.select(F.explode(F.arrays_zip(at.alias("at"), F.col("v").alias("v"))).alias("e")).select("e.at.i", "e.at.j", F.col("e.v").alias("value"))


def independent(matrix: np.ndarray, tol: float = 1e-10) -> list[int]:
    """Features, from 0, that span all of them, by Cholesky steps on a Gram matrix that take the largest rest first.

    A feature whose rest is below tol of its own sum of squares depends on those taken.
    """
    rest, own, taken = np.array(matrix, float), np.diag(matrix).copy(), []
    while len(taken) < len(rest):
        share = np.where(own > 0, np.diag(rest) / np.where(own > 0, own, 1.0), 0.0)
        share[taken] = 0.0
        if share.max() <= tol:
            break
        k = int(np.where(share > tol, np.diag(rest), -1.0).argmax())
        rest = rest - np.outer(rest[:, k], rest[k]) / rest[k, k]
        taken.append(k)
    return sorted(taken)


class _Spread:
    """Locations in a DataFrame: loc_id, x, y, f."""

    def __init__(self, df: DataFrame):
        self.df = written(df, "locations")

    def free(self, barred: list, min_dist: float | None) -> DataFrame:
        rows = self.df
        if barred:
            rows = rows.where(~F.col("loc_id").isin([b[0] for b in barred]))
            if min_dist:
                rows = rows.where(~excluded(rows, [b[2:4] for b in barred], min_dist))
        return rows

    def largest(self, inverse: np.ndarray, barred: list, min_dist: float | None) -> list:
        """The BATCH rows of largest leverage, ties by loc_id."""
        rows = self.free(barred, min_dist).withColumn("s", leverage(inverse)).orderBy(F.desc("s"), "loc_id").limit(BATCH)
        return [(r.loc_id, np.array(r.f), r.x, r.y, r.s) for r in rows.collect()]

    def best(self, matrix: np.ndarray, barred: list, min_dist: float | None):
        """(loc_id, features, x, y, score) of the row whose projection is largest; None if all are barred."""
        rows, s = self.free(barred, min_dist), projection_top(matrix)
        r = rows.agg(F.max_by(F.struct("loc_id", "f", "x", "y", s.alias("s")), F.struct(s, -F.col("loc_id"))).alias("r")).first().r
        return None if r is None else (r.loc_id, np.array(r.f), r.x, r.y, r.s)

    def first(self, k: int):
        return [(r.loc_id, np.array(r.f), r.x, r.y) for r in self.df.orderBy("loc_id").limit(k).collect()]


def _greedy(rows: _Spread, n: int, k: int, min_dist: float | None, chosen: list | None = None):
    """Adds to chosen, up to k, the row of largest leverage a(S'S)^-1 a'; starts from a ridge, under which leverage is
    largest where a row leaves the span of those before. Returns them and the number of passes."""
    chosen, inverse, passes = list(chosen or []), np.eye(n) / RIDGE, 0
    for c in chosen:
        inverse = _added(inverse, c[1])
    while len(chosen) < k:
        batch, passes = rows.largest(inverse, chosen, min_dist), passes + 1
        if not batch:
            if min_dist:
                warnings.warn(f"only {len(chosen)} locations are min_dist apart; the rest are nearer", stacklevel=4)
                min_dist = None
                continue
            raise ValueError("fewer locations than samples")
        least = batch[-1][4] if len(batch) == BATCH else -1.0
        for pick in _picks(batch, inverse, k - len(chosen), min_dist, least):
            chosen.append(pick)
            inverse = _added(inverse, pick[1])
    return chosen, passes


def _added(inverse: np.ndarray, a: np.ndarray) -> np.ndarray:
    """(S'S + a'a)^-1 from (S'S)^-1."""
    v = inverse @ a
    inverse = inverse - np.outer(v, v) / (1 + a @ v)
    return (inverse + inverse.T) / 2


def _picks(batch: list, inverse: np.ndarray, k: int, min_dist: float | None, least: float = -1.0) -> list:
    """Up to k greedy picks among rows (loc_id, features, x, y, ...), the first in any case, others while above least."""
    ids, a, xy = np.array([b[0] for b in batch]), np.array([b[1] for b in batch]), np.array([b[2:4] for b in batch], float)
    open_, out = np.ones(len(batch), bool), []
    while len(out) < k and open_.any():
        s = np.where(open_, np.einsum("ij,jk,ik->i", a, inverse, a), -1.0)
        top = np.flatnonzero(s == s.max())
        i = int(top[ids[top].argmin()])
        if out and s[i] <= least:
            break
        out.append((int(ids[i]), a[i], float(xy[i, 0]), float(xy[i, 1]), float(s[i])))
        inverse = _added(inverse, a[i])
        open_[i] = False
        if min_dist:
            open_ &= ((xy - xy[i]) ** 2).sum(1) >= min_dist**2
    return out


def _part_picks(n: int, k: int, min_dist: float | None):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("loc_id", kind="stable")
        batch = list(zip(pdf.loc_id, map(np.asarray, pdf.f), pdf.x, pdf.y, strict=True))
        got = _picks(batch, np.eye(n) / RIDGE, k, min_dist)
        return pd.DataFrame({"loc_id": [g[0] for g in got], "x": [g[2] for g in got], "y": [g[3] for g in got], "f": [g[1].tolist() for g in got], "nr": range(1, len(got) + 1)})

    return run


def _coresets(rows: _Spread, m: int, n: int, k: int, min_dist: float | None):
    """Greedy picks in every part of about PART rows, then among the picked, until one part is left; parts are by hash.

    Where picks at min_dist run out, the rest come from passes over all rows.
    """
    df, size = rows.df, max(PART, 4 * k)
    schema, level = "loc_id long, x double, y double, f array<double>, nr int", 0
    while True:
        level, parts = level + 1, -(-m // size)
        part = F.pmod(F.xxhash64("loc_id", F.lit(level)), F.lit(parts)).alias("part")
        df = written(df.select("loc_id", "x", "y", "f").groupBy(part).applyInPandas(_part_picks(n, k, min_dist), schema), "coresets")
        if parts == 1:
            break
        m = df.count()
    chosen = [(r.loc_id, np.array(r.f), r.x, r.y) for r in df.orderBy("nr").collect()]  # k at most
    if len(chosen) < k:
        chosen, more = _greedy(rows, n, k, min_dist, chosen)
        level += more
    return chosen, level


def _spaced(rows: _Spread, k: int, min_dist: float, seed: int):
    """k rows in random order no two of which are nearer than min_dist, as far as there are such."""
    apart = spaced(rows.df, min_dist, seed).orderBy("order_key", "loc_id").limit(k).collect()
    chosen = [(r.loc_id, np.array(r.f), r.x, r.y) for r in apart]
    if len(chosen) < k:
        warnings.warn("no location left at min_dist; the rest are random", stacklevel=4)
        more = rows.free(chosen, None).orderBy(order_key(seed, "loc_id"), "loc_id").limit(k - len(chosen)).collect()
        chosen += [(r.loc_id, np.array(r.f), r.x, r.y) for r in more]
    return chosen


def _pivot(rows: _Spread, names: list[str], k: int, min_dist: float | None, tol: float, most: int, seed: int):
    """Exchanges while some |a W| exceeds tol. B = A W is never stored: W is n x k, and pivoted rows are kept apart."""
    n = len(names)
    chosen = _spaced(rows, k, min_dist, seed) if min_dist else rows.first(k)
    p = np.array([c[1] for c in chosen])
    if np.linalg.matrix_rank(p) < min(n, k):
        sums = np.zeros((n, n))
        for r in gram(rows.df, n).collect():
            sums[r.i - 1, r.j - 1] = sums[r.j - 1, r.i - 1] = r.value
        spanning = independent(sums)
        if len(spanning) < n:
            raise ValueError(f"the features are linearly dependent: {', '.join(names[i] for i in range(n) if i not in spanning)}")
        warnings.warn("the first rows don't span the features; chosen by leverage instead", stacklevel=4)
        chosen, _ = _greedy(rows, n, k, min_dist)
        p = np.array([c[1] for c in chosen])
    w, kept = np.linalg.pinv(p), {}
    for step in range(most):
        barred = chosen if min_dist else []
        known = list(kept.items())
        skip = [(i, None, np.inf, np.inf) for i, _ in known]
        got = rows.best(w, barred + skip, min_dist)
        rivals = [] if got is None else [(got[4], -got[0], got, got[1] @ w)]
        held = {c[0] for c in barred}
        rivals += [(float(np.abs(b).max()), -i, row, b) for i, (row, b) in known if i not in held]
        if not rivals:
            return chosen, True, step
        top, _, row, b = max(rivals, key=lambda r: r[:2])
        if top <= tol:
            return chosen, True, step
        j = int(np.abs(b).argmax())
        v = b / b[j]
        w = w - np.outer(w[:, j], v)
        kept = {i: (r, x - x[j] * v) for i, (r, x) in kept.items()} | {row[0]: (row, v)}
        chosen[j] = row
    return chosen, False, most


def d_optimal(df: DataFrame, n: int, features: list[str] | None = None, min_dist: float | None = None, normalized: bool = True, add_coords: bool = True, method: str = "greedy", tol: float = 1.1, max_iters: int = 100, seed: int = 1) -> Samples:
    """n of the rows of df (loc_id, x, y, features...), every input column kept, with sample_id 1..n in order of choice.

    Rows with a null or non-finite feature or coordinate can't be chosen. features: all numeric columns unless named.
    """
    if method not in ("greedy", "coresets", "pivot"):
        raise ValueError("method must be greedy, coresets or pivot")
    for c in ("loc_id", "x", "y"):
        if c not in df.columns:
            raise ValueError(f"locations need a column {c}")
    names = list(features) if features is not None else numeric_features(df)
    if not names:
        raise ValueError("no numeric feature columns")
    t = df.select("loc_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), *[F.col(c).cast("double").alias(f"f_{k}") for k, c in enumerate(names)])
    cols = [f"f_{k}" for k in range(len(names))]
    if add_coords:
        t, cols = t.withColumns({"f_x": F.col("x"), "f_y": F.col("y")}), [*cols, "f_x", "f_y"]
    for c in {"x", "y", *cols}:
        t = t.where(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    m = t.count()
    if n < len(cols):
        raise ValueError(f"n must be at least the number of features, {len(cols)}")
    if n > m:
        raise ValueError(f"n is {n}, and there are {m} locations")
    if normalized:
        t = normalize(t, cols)
    t = t.select("loc_id", "x", "y", F.array(*cols).alias("f"))
    rows, converged = _Spread(t), True
    if method == "greedy":
        chosen, steps = _greedy(rows, len(cols), n, min_dist)
    elif method == "coresets":
        chosen, steps = _coresets(rows, m, len(cols), n, min_dist)
    else:
        chosen, converged, steps = _pivot(rows, [*names, "x", "y"][: len(cols)], n, min_dist, tol, max_iters, seed)
    picked = df.sparkSession.createDataFrame([(int(c[0]), k) for k, c in enumerate(chosen, 1)], "pick_id long, sample_id int")
    out = df.join(F.broadcast(picked), df.loc_id == picked.pick_id).drop("pick_id")
    return Samples(out, "maxvol", n, None, {"method": method, "features": ", ".join(names), "converged": converged, "iterations": steps})
