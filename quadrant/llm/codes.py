"""Vector codes: each part of a vector as the number of its nearest codebook entry, codebooks by Hamerly's form of Lloyd's rounds.

Components are integers, so assignments, means and errors are exact. A round is one pass over the vectors: each row carries,
for every part, its entry, an upper bound on its distance to it and a lower bound on that to the second-nearest one. The
bounds are moved by what the entries moved; where the upper stays strictly below the lower, or below half the way from its
entry to the next, no other entry can be as near, and the part keeps it unseen. Else the distance to its own entry is
computed, and only if that fails too, those to all, of which the first of the nearest wins. Bounds are rounded outwards.
A round's rows are written to the shared folder, and sums by entry are added up in tasks before they are shuffled; the
driver holds the codebooks, whose size doesn't depend on the table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrant.llm.common import table, written

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Rows whose distances to all entries are held at once.
SCAN = 4096
#: Totals by label up to this many are broadcast, more are joined with this many salts a label.
MOST_LABELS, SALTS = 100_000, 64
STATE = "vec_id {id}, label {label}, v binary, code binary, upper binary, lower binary"


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter((x * (1 + 1e-6)).astype(np.float32), np.float32(np.inf))


def _down(x: np.ndarray) -> np.ndarray:
    return np.nextafter((x * (1 - 1e-6)).astype(np.float32), np.float32(-np.inf))


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of integers to all entries, as float64 where that holds them exactly, else as int64."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * most * most * max(1, x.shape[1]) < 1 << 53:
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]
    if 4 * most * most * max(1, x.shape[1]) >= 1 << 63:
        raise ValueError("components are too large for squared distances in 64 bits")
    return np.stack([((x - e) * (x - e)).sum(1) for e in entries], 1)


class Codebook:
    """One part's entries, how far each may have moved since the round before, and half the way from each to the next."""

    def __init__(self, entries: np.ndarray, before: np.ndarray | None = None):
        self.entries = entries
        gaps = squared(entries, entries).astype(np.float64)
        np.fill_diagonal(gaps, np.inf)
        self.half = _down(np.sqrt(gaps.min(1)) / 2).astype(np.float64)
        moved = np.zeros(len(entries)) if before is None else np.sqrt(((entries - before).astype(np.float64) ** 2).sum(1))
        self.moved = _up(moved).astype(np.float64)
        order = np.argsort(-self.moved, kind="stable")
        self.others = np.full(len(entries), self.moved[order[0]])  # the farthest that any other entry moved
        self.others[order[0]] = self.moved[order[1]] if len(order) > 1 else 0.0

    def own(self, x: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Squared distances of rows to their own entries."""
        d = x - self.entries[code]
        return (d * d).sum(1)

    def scan(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest entries, the first of equals, and bounds on the distances to them and to the second-nearest."""
        code, near, second = np.empty(len(x), np.int64), np.empty(len(x)), np.full(len(x), np.inf)
        for a in range(0, len(x), SCAN):
            d = squared(x[a : a + SCAN], self.entries)
            rows = np.arange(len(d))
            code[a : a + SCAN] = best = d.argmin(1)
            near[a : a + SCAN] = d[rows, best]
            if d.shape[1] > 1:
                d = d.astype(np.float64)
                d[rows, best] = np.inf
                second[a : a + SCAN] = d.min(1)
        return code, _up(np.sqrt(near)), _down(np.sqrt(second))

    def assign(self, x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """The same for rows with codes and bounds of the round before, and how many rows were scanned."""
        code, upper, lower = code.astype(np.int64), _up(upper + self.moved[code]), _down(lower - self.others[code])
        bound = np.maximum(self.half[code], lower)
        open_ = np.flatnonzero(~(upper < bound))
        upper[open_] = _up(np.sqrt(self.own(x[open_], code[open_]).astype(np.float64)))
        open_ = open_[~(upper[open_] < bound[open_])]
        code[open_], upper[open_], lower[open_] = self.scan(x[open_])
        return code, upper, lower, len(open_)


def _width(most: int) -> str:
    return "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"


def _bytes(rows: np.ndarray, kind: str) -> list[bytes]:
    rows = np.ascontiguousarray(rows.astype(kind))
    return [r.tobytes() for r in rows]


def _matrix(column: pd.Series, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(len(column), -1)


def _first(books: list[Codebook], kind: str):
    """Integers of vectors, their codes and bounds."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                v = np.floor(np.stack([np.asarray(e, np.float64) for e in pdf.embedding]) * SCALE).astype(np.int64)
                found = [b.scan(x) for b, x in zip(books, np.split(v, PARTS, 1), strict=True)]
                yield _state(pdf, v, kind, found)

    return run


def _state(pdf: pd.DataFrame, v: np.ndarray, kind: str, found: list) -> pd.DataFrame:
    code, upper, lower = (np.stack([f[k] for f in found], 1) for k in range(3))
    return pd.DataFrame({"vec_id": pdf.vec_id, "label": pdf.label, "v": _bytes(v, kind), "code": _bytes(code, "u1"), "upper": _bytes(upper, "<f4"), "lower": _bytes(lower, "<f4")})


def _next(books: list[Codebook], kind: str):
    """Codes and bounds after the entries moved."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                v = _matrix(pdf.v, kind).astype(np.int64)
                code, upper, lower = (_matrix(pdf[c], k) for c, k in (("code", "u1"), ("upper", "<f4"), ("lower", "<f4")))
                found = [b.assign(x, code[:, p], upper[:, p], lower[:, p]) for p, (b, x) in enumerate(zip(books, np.split(v, PARTS, 1), strict=True))]
                yield _state(pdf, v, kind, found)

    return run


def _sums(kind: str, entries: int):
    """A task's count and sum of parts by part and entry."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count, total = np.zeros((PARTS, entries), np.int64), None
        for pdf in batches:
            if len(pdf):
                v, code = _matrix(pdf.v, kind).astype(np.int64), _matrix(pdf.code, "u1")
                total = np.zeros((PARTS, entries, v.shape[1] // PARTS), np.int64) if total is None else total
                for p, x in enumerate(np.split(v, PARTS, 1)):
                    np.add.at(total[p], code[:, p], x)
                    count[p] += np.bincount(code[:, p], minlength=entries)
        for p, e in zip(*np.nonzero(count), strict=True):
            yield pd.DataFrame({"part": [int(p)], "entry": [int(e)], "n": [int(count[p, e])], "total": [total[p, e].tolist()]})

    return run


def _moved(state: DataFrame, books: list[Codebook], kind: str) -> list[Codebook]:
    """Codebooks of the means of their parts, rounded down; an entry without parts stays."""
    entries, width = books[0].entries.shape
    partial = state.select("v", "code").mapInPandas(_sums(kind, entries), "part int, entry int, n long, total array<long>")
    found = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(width)]).collect()
    new = [b.entries.copy() for b in books]
    for r in found:
        new[r.part][r.entry] = [r[f"t{i}"] // r.n for i in range(width)]
    return [Codebook(n, b.entries) for n, b in zip(new, books, strict=True)]


def _coded(books: list[Codebook], kind: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                v, code = _matrix(pdf.v, kind).astype(np.int64), _matrix(pdf.code, "u1")
                error = sum(b.own(x, code[:, p]) for p, (b, x) in enumerate(zip(books, np.split(v, PARTS, 1), strict=True)))
                yield pd.DataFrame({"vec_id": pdf.vec_id, "label": pdf.label, "code": [c.tobytes().hex() for c in code], "error": error})

    return run


def codebook_text(books: list[Codebook]) -> str:
    """All entries' components by part, entry and position."""
    return ",".join(str(x) for b in books for e in b.entries.tolist() for x in e)


def _with_totals(coded: DataFrame) -> DataFrame:
    """coded with label_error, its errors summed over equal labels; a label may hold any share of the rows."""
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    if totals.count() <= MOST_LABELS:
        return coded.join(F.broadcast(totals), F.col("label").eqNullSafe(F.col("of"))).drop("of")
    totals = totals.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = coded.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    return salted.join(totals, F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("at"))).drop("of", "at", "salt")


def compress(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of the rows of vectors (vec_id, embedding, label).

    Rows whose embedding is null or holds null, NaN or infinite components are dropped. Codebooks start as the parts of the
    ENTRIES rows of smallest vec_id, null ids last, rows that repeat an id in order of their components; of fewer rows, as
    all of them. Null labels are one label. Repeated rows are each returned. Other columns are ignored. No rows kept: an
    empty table. Vectors of several lengths, or of one that PARTS doesn't divide, are an error, as are components whose
    squared distances exceed 64 bits.
    """
    spark = vectors.sparkSession
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    e = F.col("embedding")
    finite = F.forall(e, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    kept = vectors.select("vec_id", "label", "embedding").where(e.isNotNull() & F.coalesce(finite, F.lit(False)))
    final = f"vec_id {kinds['vec_id']}, code string, error long, label_error long, codebooks_sha256 string"
    facts = kept.agg(F.min(F.size(e)).alias("least"), F.max(F.size(e)).alias("most"), F.max(F.array_max(F.transform(e, lambda x: F.abs(x.cast("double"))))).alias("top")).first()
    if facts.least is None:
        return spark.createDataFrame([], final)
    if facts.least != facts.most or facts.most % PARTS or not facts.most:
        raise ValueError(f"vectors must have one length that {PARTS} divides; found {facts.least} to {facts.most}")
    if facts.top >= 2**50:
        raise ValueError("components are too large for squared distances in 64 bits")
    kind = _width(int(facts.top * SCALE) + 1)
    ints = F.transform(e, lambda x: F.floor(x.cast("double") * SCALE))
    seeds = np.array([r.i for r in kept.select("vec_id", ints.alias("i")).orderBy(F.col("vec_id").asc_nulls_last(), "i").limit(ENTRIES).collect()], np.int64)
    books = [Codebook(x) for x in np.split(seeds, PARTS, 1)]
    schema = STATE.format(id=kinds["vec_id"], label=kinds["label"])
    state = written(kept.mapInPandas(_first(books, kind), schema), "codes-0")
    for k in range(1, ROUNDS + 1):
        books = _moved(state, books, kind)
        state = written(state.mapInPandas(_next(books, kind), schema), f"codes-{k}")
    coded = written(state.select("vec_id", "label", "v", "code").mapInPandas(_coded(books, kind), f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"), "codes")
    digest = hashlib.sha256(codebook_text(books).encode()).hexdigest()
    return _with_totals(coded).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """compress() of all embeddings."""
    return compress(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """Every part against every entry in each round: right, and for small tables."""
    ctes = [
        f"k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, iv) AS id, vec_id, label, iv FROM (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS iv FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: coalesce(isfinite(CAST(x AS DOUBLE)), false))) = len(embedding)))",
        f"p AS MATERIALIZED (SELECT id, CAST(part AS INTEGER) AS part, iv[part * len(iv) // {PARTS} + 1:(part + 1) * len(iv) // {PARTS}] AS pv FROM k, range({PARTS}) r(part))",
        f"c0 AS MATERIALIZED (SELECT part, id - 1 AS entry, pv AS cv FROM p WHERE id <= {ENTRIES})",
    ]
    for t in range(ROUNDS + 1):
        ctes.append(f"a{t} AS MATERIALIZED (SELECT id, part, any_value(pv) AS pv, min({{'d': d, 'e': entry}}) AS m FROM (SELECT id, p.part, pv, entry, CAST(list_sum(list_transform(list_zip(pv, cv), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM p JOIN c{t} c ON c.part = p.part) GROUP BY id, part)")
        if t < ROUNDS:
            ctes.append(f"s{t} AS (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS cv FROM (SELECT part, m.e AS entry, i, CAST(sum(pv[i]) AS BIGINT) AS s, count(*) AS n FROM (SELECT part, m, pv, unnest(range(1, len(pv) + 1)) AS i FROM a{t}) GROUP BY part, m.e, i) GROUP BY part, entry)")
            ctes.append(f"c{t + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(s.cv, c.cv) AS cv FROM c{t} c LEFT JOIN s{t} s ON s.part = c.part AND s.entry = c.entry)")
    ctes.append(f"o AS (SELECT id, string_agg(format('{{:02x}}', m.e), '' ORDER BY part) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY id)")
    ctes.append(f"h AS (SELECT sha256(string_agg(array_to_string(cv, ','), ',' ORDER BY part, entry)) AS h FROM c{ROUNDS})")
    return f"WITH {', '.join(ctes)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM o JOIN k USING (id), h"


SQL = _sql()
