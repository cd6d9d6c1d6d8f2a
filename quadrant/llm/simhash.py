"""Near-duplicates by SimHash fingerprints, linked through an inverted index of their bytes by position.

Two fingerprints of 8 bytes that differ in at most 3 bits share at least 5 bytes in place, so they share one of the four
pairs of neighbouring bytes. A pair's value is a list of the index; within a list, each of the other bytes' values is a
list again, and a pair of fingerprints is tallied once for every list that it shares: pairs that reach the guaranteed
minimum are verified by their differing bits. A list of more than LIST fingerprints isn't tallied as a whole but divided by
further bytes, of which those pairs still share enough: by two of the next three or two of the last three, then by one of
four, then by one of four six-bit pieces of what is left. The lists that remain hold at most 2^18 fingerprints, as no more
exist, and are linked by looking up the 987 ways to change up to three of the last 18 bits. Every task returns one link
a fingerprint at most, to the first of those that it hangs together with, so dense groups don't give all their pairs.
Equal fingerprints are one class throughout.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrant.llm.common import table, written
from quadrant.llm.graphs import components

SHINGLE, BITS, SEED = 3, 3, 42
SHARED = 8 - BITS
#: LIST: fingerprints that are tallied together; SMALL: those of a list for which pairs are compared without lists of their bytes.
LIST, SMALL = 4096, 32
CHUNK = 1 << 16
#: Heavy lists up to this many are broadcast.
MOST_HEAVY = 500_000
#: Bits that each level appends to the key of a list: number of the piece, then its value.
_LEVELS = ((2, 16), (3, 16), (2, 8), (2, 6))


def fingerprint(text: bytes | None) -> int:
    """Majority bits of the XXH64 of all runs of SHINGLE words, repeats included; of all words, if fewer; 0 without words."""
    words = bytes(text).lower().split() if text is not None else []  # ASCII only, both
    if not words:
        return 0
    joined, size = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    runs = max(1, len(words) - SHINGLE + 1)
    starts, ends = (end - size)[:runs].tolist(), end[len(words) - runs :].tolist()
    set_ = np.zeros(64, np.int64)
    for a in range(0, runs, CHUNK):
        pieces = map(joined.__getitem__, map(slice, starts[a : a + CHUNK], ends[a : a + CHUNK]))
        h = np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(SEED)), np.uint64, min(CHUNK, runs - a))
        set_ += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * set_ > runs, bitorder="little").view(np.int64)[0])


def _signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"doc_id": pdf.doc_id, "fp": np.fromiter(map(fingerprint, pdf.text), np.int64, len(pdf))}).astype({"doc_id": "Int64"})


def _rest(path: tuple[int, ...]) -> list[int]:
    """Byte positions that the pieces of a list's key leave open."""
    open_ = list(range(8))
    if path:
        open_ = [p for p in open_ if p // 2 != path[0]]
    if len(path) > 1:
        two = _two(open_, path[1])
        open_ = [p for p in open_ if p not in two]
    if len(path) > 2:
        open_.pop(path[2])
    return open_


def _two(open_: list[int], piece: int) -> list[int]:
    three = open_[3 * (piece // 3) :][:3]
    return [p for k, p in enumerate(three) if k != piece % 3]


def _field(fp: np.ndarray, positions: list[int]) -> np.ndarray:
    """The bytes at positions, one after another, as a number."""
    out = np.zeros(len(fp), np.uint64)
    for p in positions:
        out = (out << np.uint64(8)) | ((fp >> np.uint64(8 * p)) & np.uint64(255))
    return out


def _paths(key: np.ndarray, level: int) -> np.ndarray:
    """Numbers of the pieces that make up keys of a level, a column each."""
    out, key = [], key.astype(np.uint64)
    for bits, value in reversed(_LEVELS[:level]):
        key = key >> np.uint64(value)
        out.append(key & np.uint64((1 << bits) - 1))
        key = key >> np.uint64(bits)
    return np.stack(out[::-1], 1).astype(np.int64)


def _pieces(fp: np.ndarray, path: tuple[int, ...]) -> list[np.ndarray]:
    """Values of the pieces by which fingerprints of a list are divided further."""
    open_ = _rest(path)
    if len(path) == 1:
        return [_field(fp, _two(open_, k)) for k in range(6)]
    if len(path) == 2:
        return [_field(fp, [p]) for p in open_]
    return [(_field(fp, open_) >> np.uint64(6 * k)) & np.uint64(63) for k in range(4)]


def _divided(level: int):
    """Entries of lists of a level as entries of lists of the next."""
    bits, value = _LEVELS[level]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            key, fp = pdf.key.to_numpy(np.int64).view(np.uint64), pdf.fp.to_numpy(np.int64).view(np.uint64)
            paths = _paths(key, level)
            for path in np.unique(paths, axis=0) if len(pdf) else ():
                at = np.flatnonzero((paths == path).all(1))
                for k, v in enumerate(_pieces(fp[at], tuple(path.tolist()))):
                    new = (((key[at] << np.uint64(bits)) | np.uint64(k)) << np.uint64(value)) | v
                    yield pd.DataFrame({"key": new.view(np.int64), "fp": fp[at].view(np.int64), "node": pdf.node.to_numpy()[at]})

    return run


def _joined(a: np.ndarray, b: np.ndarray, n: int, first: np.ndarray | None = None) -> np.ndarray:
    """For each of n rows the first of those that the pairs connect it with, by minima that spread along them."""
    first = np.arange(n) if first is None else first
    while len(a):
        least = np.minimum(first[a], first[b])
        new = first.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        np.minimum.at(new, first[a], least)
        np.minimum.at(new, first[b], least)
        new = new[new]
        if (new == first).all():
            break
        first = new
    return first


def _verified(fp: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fp[a] ^ fp[b]) <= BITS


def _small(fp: np.ndarray, group: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of rows of the same group, of at most `most` rows; rows of a group lie together."""
    found = [(np.empty(0, np.int64),) * 2]
    for s in range(1, most):
        a = np.flatnonzero(group[s:] == group[:-s])
        shared = ((fp[a] ^ fp[a + s]).view(np.uint8).reshape(-1, 8) == 0).sum(1)
        a = a[shared >= SHARED]
        a = a[_verified(fp, a, a + s)]
        found.append((a, a + s))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _tallied(fp: np.ndarray, first: np.ndarray) -> np.ndarray:
    """_joined() of a list of many: a tally of shared bytes by pair, added up over the lists of each position."""
    n = len(fp)
    tally, bytes_ = np.zeros((n, n), np.uint8), fp.view(np.uint8).reshape(n, 8)
    for p in range(8):
        order = np.argsort(bytes_[:, p], kind="stable")
        for members in np.split(order, np.flatnonzero(np.diff(bytes_[order, p])) + 1):
            if len(members) == n:
                tally += 1
            elif len(members) > 1:
                tally[np.ix_(members, members)] += 1
    for a in range(0, n, 256):  # bounds what is held of the pairs
        i, j = np.nonzero(tally[a : a + 256] >= SHARED)
        i += a
        i, j = i[i < j], j[i < j]
        ok = _verified(fp, i, j)
        first = _joined(i[ok], j[ok], n, first)
    return first


def _changes(bits: int) -> list[int]:
    return [sum(1 << p for p in c) for k in range(1, BITS + 1) for c in combinations(range(bits), k)]


def _looked_up(fp: np.ndarray, path: tuple[int, ...], first: np.ndarray) -> np.ndarray:
    """_joined() of a list of the last level, whose fingerprints are told apart by 18 bits."""
    last = _field(fp, _rest(path[:3])).astype(np.int64)
    low = last & ((1 << 6 * path[3]) - 1)
    x = (last >> (6 * path[3] + 6) << 6 * path[3]) | low
    at = np.full(1 << 18, -1)
    at[x] = np.arange(len(x))
    while True:
        before = first
        for change in _changes(18):
            other = at[x ^ change]
            rows = np.flatnonzero(other >= 0)
            first = first.copy()
            first[rows] = np.minimum(first[rows], first[other[rows]])
        first = first[first]
        if (first == before).all():
            return first


def _linked(level: int):
    """Links among the fingerprints of each list. Rows come sorted by key, and each key's in one partition."""

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        key, fp, node = pdf.key.to_numpy(np.int64), pdf.fp.to_numpy(np.int64).view(np.uint64), pdf.node.to_numpy(np.int64)
        bounds = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
        size = np.diff(bounds)
        group = np.repeat(np.arange(len(size)), size)
        little = np.flatnonzero(np.repeat(size <= SMALL, size))
        a, b = _small(fp[little], group[little], min(SMALL, int(size.max())))
        first = _joined(little[a], little[b], len(fp))
        for g in np.flatnonzero(size > SMALL):
            lo, hi = bounds[g], bounds[g + 1]
            if level == len(_LEVELS) and hi - lo > LIST:
                path = tuple(_paths(key[lo : lo + 1].view(np.uint64), level)[0].tolist())
                first[lo:hi] = lo + _looked_up(fp[lo:hi], path, np.arange(hi - lo))
            else:
                first[lo:hi] = lo + _tallied(fp[lo:hi], np.arange(hi - lo))
        rows = np.flatnonzero(first != np.arange(len(first)))
        return pd.DataFrame({"a": node[rows], "b": node[first[rows]]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            if not len(pdf):
                continue
            last = np.flatnonzero(pdf.key.to_numpy() != pdf.key.iat[-1])
            cut = int(last[-1]) + 1 if len(last) else 0  # the last list may go on in the next batch
            if cut:
                yield of(pd.concat([*held, pdf.iloc[:cut]], ignore_index=True))
                held = []
            elif held and held[-1].key.iat[-1] != pdf.key.iat[-1]:
                yield of(pd.concat(held, ignore_index=True))
                held = []
            held.append(pdf.iloc[cut:])
        if held:
            yield of(pd.concat(held, ignore_index=True))

    return run


def links(classes: DataFrame) -> DataFrame:
    """(a, b): links that connect those nodes of classes (fp, node), no two of one fp, that differ in BITS bits at most."""
    entries = classes.select("fp", "node", F.posexplode(F.array(*[F.shiftrightunsigned("fp", 16 * k).bitwiseAND(0xFFFF) for k in range(4)])).alias("piece", "value"))
    entries = entries.select((F.col("piece") * (1 << 16) + F.col("value")).alias("key"), "fp", "node")
    found = None
    for level in range(1, len(_LEVELS) + 1):
        ready, heavy = entries, None
        if level < len(_LEVELS):
            entries = written(entries, f"simhash-{level}") if level > 1 else entries
            heavy = written(entries.groupBy("key").count().where(F.col("count") > LIST).select(F.col("key").alias("heavy")), "simhash-heavy")
            n = heavy.count()
            if n:
                heavy = F.broadcast(heavy) if n <= MOST_HEAVY else heavy
                ready = entries.join(heavy, F.col("key") == F.col("heavy"), "left_anti")
        here = ready.repartition("key").sortWithinPartitions("key").select("key", "fp", "node").mapInPandas(_linked(level), "a long, b long")
        found = here if found is None else found.unionByName(here)
        if heavy is None or not n:
            break
        entries = entries.join(heavy, F.col("key") == F.col("heavy"), "left_semi").select("key", "fp", "node").mapInPandas(_divided(level), "key long, fp long, node long")
    return found


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id of each row of docs (doc_id, text).

    Null, empty or blank text: fingerprint zero, linked like any other, so all such rows are one component. Equal texts are
    linked. Repeated rows: each returned. Null doc_id: its component is null, and nothing is linked through it. Other columns
    are ignored. Empty table: empty.
    """
    signed = written(docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInPandas(_signed, "doc_id long, fp long"), "simhash-signed")
    classes = written(signed.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("node")), "simhash-classes")
    of_class = classes.join(components(links(classes)), "node", "left").select("fp", F.coalesce("component", "node").alias("component"))
    out = signed.join(of_class, "fp", "left")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_duplicates() of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))
