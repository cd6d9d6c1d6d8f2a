"""Near-duplicates by min-max hashing.

Texts with equal shingle sets are one class, and only one text a class goes on. Each of PERMUTATIONS hash functions
gives two signature values, its minimum and its maximum over the set, so half as many evaluations give as long a
signature; min and max of one permutation are negatively correlated, so the estimate is unbiased with lower variance.
Bands of a few values key buckets, of those with the same texts one stays. Texts that share a bucket are candidates, and one
rule confirms them on full shingle sets, however many they are: of each bucket one text, the pivot, is compared with all
others that no links tie to it yet, blocks of them a task, and leaves the bucket. What is tied together by then needs no
further comparison, so a bucket of copies is done in a pass that grows with its size, and one of up to PIVOTS + 1 texts
however alike. Where more texts stay apart, those of different components are compared in pairs of blocks of bounded size, one
task each, and a task returns a spanning forest of the links it finds, never all of them. The links' components are the
result: a text that no chain of links reaches stays alone. The threshold fixes the bands: 21 of 6 values at 0.85, 25 of 5 at 0.8, so that two
texts at the threshold miss all of them with probability 5e-5, if values agree independently.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrant.llm.common import released, table, written
from quadrant.llm.graphs import components

SHINGLE, PERCENT = 5, 85
#: MISS: chance at most, of two texts at the threshold to share no band.
PERMUTATIONS, MISS = 64, 1e-4
#: A block has about this many shingles, counting at least LEAST a text. Pivots are taken from a bucket so many times.
BLOCK, LEAST, PIVOTS = 400_000, 1600, 2
CACHE = 150_000
MULTIPLIERS = (np.random.default_rng(7).integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
STEP, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class _Hashes(dict):
    """64-bit hash by word, kept for words seen again; emptied before it grows beyond CACHE."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < CACHE:
            self[word] = h
        return h


_hashes = _Hashes()


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's runs of SHINGLE words; of all its words, if fewer; none without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if isinstance(text, str) else []  # ASCII only, both
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, n)
    m = max(1, n - SHINGLE + 1)
    with np.errstate(over="ignore"):
        s = np.full(m, np.uint64(min(n, SHINGLE)))
        for k in range(min(n, SHINGLE)):
            s = s * STEP + h[k : k + m]
        s ^= s >> np.uint64(32)
        s *= MIX
        s ^= s >> np.uint64(29)
    return np.unique(s)


def band_rows(percent: int) -> int:
    """Values a band: as many as leave two texts at similarity percent a chance of MISS at most to share no band."""
    return max((r for r in range(2, 2 * PERMUTATIONS) if (1 - (percent / 100) ** r) ** (2 * PERMUTATIONS // r) <= MISS), default=1)


def band_keys(sets: list[np.ndarray], band: int) -> np.ndarray:
    """Keys for each set, one for every band of so many values; no set may be empty."""
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    flat = np.concatenate(sets)
    values = np.empty((2 * PERMUTATIONS, len(sets)), np.uint64)
    with np.errstate(over="ignore"):
        for p, a in enumerate(MULTIPLIERS):
            v = ((flat * a) >> np.uint64(32)).astype(np.uint32)
            values[2 * p] = np.minimum.reduceat(v, starts)
            values[2 * p + 1] = np.maximum.reduceat(v, starts)
        keys = np.empty((len(sets), 2 * PERMUTATIONS // band), np.uint64)
        for b in range(keys.shape[1]):
            k = np.full(len(sets), np.uint64(b + 1))
            for r in range(band):
                k = (k ^ values[b * band + r]) * STEP
                k ^= k >> np.uint64(31)
            keys[:, b] = k
    return keys.view(np.int64)


def _signed(band: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at = 0
            while at < len(pdf):
                sets, total, start = [], 0, at
                while at < len(pdf) and total < 400_000:  # bounds the arrays, however long the texts
                    sets.append(shingles(pdf.text.iat[at]))
                    total += len(sets[-1])
                    at += 1
                full = [s for s in sets if len(s)]
                keys = iter(band_keys(full, band) if full else ())
                out = pdf.iloc[start:at][["doc_id"]].assign(n_shingles=[len(s) for s in sets])
                out["digest"] = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                out["bands"] = [next(keys) if len(s) else None for s in sets]
                yield out.astype({"doc_id": "Int64", "n_shingles": "int64"})
            released()
        _hashes.clear()

    return run


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for at in range(0, len(pdf), 64):
            part = pdf.iloc[at : at + 64]
            sets = [shingles(t) for t in part.text]
            same = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() == bytes(d) for s, d in zip(sets, part.digest, strict=True)]
            yield part[["node", "digest"]].assign(shingles=[s.tobytes() for s in sets])[same]
        released()
    _hashes.clear()


def _linked(sets: list[np.ndarray], cross: np.ndarray | None, label: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs with similarity of percent or more and two labels. cross: only pairs that differ in it."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), size)
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    column, owner = column[shared], owner[shared]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    common = np.zeros((n, n), np.float32)
    width, top = 4096, int(column[-1]) + 1 if len(column) else 0
    for a in range(0, top, width):
        lo, hi = np.searchsorted(column, (a, a + width))
        m = np.zeros((n, min(width, top - a)), np.float32)
        m[owner[lo:hi], column[lo:hi] - a] = 1
        common += m @ m.T  # counts under 2^24 are exact in 32 bits
    union = size[:, None] + size[None, :] - common
    near = np.triu(100.0 * common.astype(np.float64) >= percent * union.astype(np.float64), 1)
    near &= label[:, None] != label[None, :]
    if cross is not None:
        near &= cross[:, None] != cross[None, :]
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for i, j in zip(*np.nonzero(near), strict=True):
        a, b = find(int(i)), find(int(j))
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((int(i), int(j)))
    return out


def _confirm(percent: int):
    """Links within one pair of blocks. The blocks of a pair are equal for links within a block."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", kind="stable").drop_duplicates(["node", "shingles"]).reset_index(drop=True)
        sets = [np.frombuffer(b, np.uint64) for b in pdf.shingles]
        cross = pdf.own.to_numpy() if pdf.one.iat[0] != pdf.two.iat[0] else None
        node = pdf.node.to_numpy()
        found = _linked(sets, cross, pdf.label.to_numpy(), percent) if len(sets) > 1 else []
        return pd.DataFrame({"a": [node[i] for i, _ in found], "b": [node[j] for _, j in found]}, dtype="int64")

    return run


def _near_pivot(percent: int):
    """Links of a pivot to texts of one block; the pivot's own row is among them."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["node", "shingles"])
        own = (pdf["node"] == pdf["pivot"]).to_numpy()
        pivots, rest = [np.frombuffer(b, np.uint64) for b in pdf.shingles[own]], pdf[~own]
        near = np.zeros(len(rest), bool)
        if len(rest):
            sets = [np.frombuffer(b, np.uint64) for b in rest.shingles]
            size, flat = np.array([len(s) for s in sets]), np.concatenate(sets)
            starts = np.cumsum(size) - size
            for pivot in pivots:  # more than one only where rows repeat an id with other texts
                at = np.minimum(np.searchsorted(pivot, flat), len(pivot) - 1)
                common = np.add.reduceat((pivot[at] == flat).astype(np.int64), starts)
                near |= 100 * common >= percent * (size + len(pivot) - common)
        return pd.DataFrame({"a": rest["pivot"][near].astype("int64"), "b": rest.node[near].astype("int64")})

    return run


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text). percent: least similarity of a link.

    Null, empty or blank text: an empty set, linked with nothing. Rows with one text: linked, if it has words. Repeated
    rows: each returned, as one document. Null doc_id: its component is null, and it is kept. Empty table: empty.
    """
    signed = written(docs.select("doc_id", "text").mapInPandas(_signed(band_rows(percent)), "doc_id long, n_shingles long, digest binary, bands array<long>"), "dedup-signatures")
    classes = signed.where("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest").agg(F.min(F.struct("doc_id", "n_shingles", "bands")).alias("x"))
    classes = written(classes.select("digest", F.col("x.doc_id").alias("node"), "x.n_shingles", "x.bands"), "dedup-classes")
    links = components(_links(docs, classes, percent))
    of_class = classes.join(links, "node", "left").select("digest", F.coalesce("component", "node").alias("component_id"))
    out = signed.select("doc_id", "n_shingles", "digest").join(of_class, "digest", "left")
    own = F.when(F.col("digest").isNull() | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    out = out.select("doc_id", "n_shingles", own.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _once(rows: DataFrame) -> DataFrame:
    """rows (key, node, digest and more) of buckets, of buckets with the same texts only one."""
    marks = [F.bit_xor(F.xxhash64(*c)).alias(n) for n, c in (("m1", ["digest"]), ("m2", ["node", "digest"]))]
    buckets = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("low"), *marks).where("n > 1")
    return rows.join(buckets.groupBy("n", "low", "m1", "m2").agg(F.min("key").alias("key")).select("key"), "key")


def _cut(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """node, digest, shingles of the classes (node, digest); texts are read and cut here only, not once a pass."""
    texts = docs.where("doc_id IS NOT NULL").select("doc_id", "text").join(classes.hint("shuffle_hash"), F.col("doc_id") == F.col("node"))
    return written(texts.select("node", "digest", "text").mapInPandas(_sets, "node long, digest binary, shingles binary"), "dedup-sets")


def _blocks(weight: str) -> list:
    """n, how many blocks texts of this weight take together, and own, that of a text."""
    n = F.ceil(F.col(weight) / BLOCK).cast("int")
    return [n.alias("n"), F.pmod(F.xxhash64("node"), n).cast("int").alias("own")]


def _tried(sets: DataFrame, left: DataFrame, pivots: DataFrame, percent: int) -> DataFrame:
    """(a, b): links of the buckets' pivots to texts of other labels."""
    pairs = left.join(pivots, "key").where("label <> pivot_label")
    # the smaller set is at most the intersection, the larger one at least the union
    fits = 100 * F.least("n_shingles", "pivot_shingles") >= percent * F.greatest("n_shingles", "pivot_shingles")
    pairs = written(pairs.where(fits).select("pivot", "pivot_digest", "node", "digest", "n_shingles").distinct(), "dedup-pairs")
    totals = pairs.groupBy("pivot").agg(F.sum(F.greatest("n_shingles", F.lit(LEAST))).alias("total"))
    others = pairs.select("pivot", "node", "digest").distinct().join(totals, "pivot").select("node", "digest", "pivot", *_blocks("total"))
    # a pivot goes to all of its blocks
    own = pairs.select("pivot", F.col("pivot_digest").alias("digest")).distinct().join(totals, "pivot").select(F.col("pivot").alias("node"), "digest", "pivot", *_blocks("total")[:1], F.lit(-1).alias("own"))
    sets = sets.join(others.unionByName(own).hint("shuffle_hash"), ["node", "digest"])
    block = F.when(F.col("own") < 0, F.sequence(F.lit(0), F.col("n") - 1)).otherwise(F.array("own"))
    sets = sets.select("node", "pivot", F.explode(block).alias("block"), "shingles")
    return sets.groupBy("pivot", "block").applyInPandas(_near_pivot(percent), "a long, b long")


def _links(docs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that connect what full-set similarity connects among the classes that share a band."""
    left = _once(classes.select("node", "digest", "n_shingles", F.explode("bands").alias("key")))
    left = written(left.withColumn("label", F.col("node")), "dedup-buckets")
    sets = _cut(docs, left.select("node", "digest").distinct())
    links = left.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    for _ in range(PIVOTS):
        # the smallest text of a bucket's smallest component
        least = left.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("node", "digest", "n_shingles")).alias("p")).groupBy("key").agg(F.min(F.struct("n", "p", "label")).alias("x"))
        pivots = written(least.select("key", F.col("x.p.node").alias("pivot"), F.col("x.p.digest").alias("pivot_digest"), F.col("x.p.n_shingles").alias("pivot_shingles"), F.col("x.label").alias("pivot_label")), "dedup-pivots")
        links = written(links.unionByName(_tried(sets, left, pivots, percent)), "dedup-links")
        rest = left.join(pivots.select("key", "pivot_digest"), "key").where("digest <> pivot_digest").drop("pivot_digest", "label")
        rest = written(rest.join(components(links), "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component"), "dedup-rest")
        apart = rest.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key")
        left = written(rest.join(apart, "key"), "dedup-buckets")
        if left.isEmpty():
            return links
    left = written(_once(left), "dedup-buckets")
    totals = left.groupBy("key").agg(F.sum(F.greatest("n_shingles", F.lit(LEAST))).alias("total"))
    places = left.join(totals, "key").select("node", "digest", "key", "label", *_blocks("total"))
    sets = sets.join(places.hint("shuffle_hash"), ["node", "digest"])
    # each block meets each other block, and itself
    sets = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    sets = sets.select("node", "key", "label", "own", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), "shingles")
    return links.unionByName(sets.groupBy("key", "one", "two").applyInPandas(_confirm(percent), "a long, b long"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates among all documents, as the query's contract has it."""
    return near_duplicates(table(spark, sf_dir, "documents"), PERCENT)


#: All pairs that share a shingle: right, and for small tables.
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
  s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
  p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
  l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
  e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
  r(doc_id, seen) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.seen),
  m AS (SELECT doc_id, min(seen) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept FROM documents d JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)
"""
