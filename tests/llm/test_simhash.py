import random

import numpy as np
import pytest
import xxhash
from conftest import WORD
from pyspark.sql import functions as F

from quadrant.llm import simhash
from quadrant.llm.registry import queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_fingerprint(text):
    words = WORD.findall((text or "").translate(LOWER))
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(pairs):
    """pairs: (id, fingerprint); the smallest id that each reaches, by comparing all distinct fingerprints."""
    fps = sorted({f for _, f in pairs})
    x, root = np.array(fps, np.uint64), list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(x[i] ^ x[i + 1 :]) <= 3):
            a, b = sorted((find(i), find(i + 1 + int(j))))
            root[b] = a
    of = {f: find(k) for k, f in enumerate(fps)}
    least = {}
    for i, f in pairs:
        least[of[f]] = min(least.get(of[f], i), i)
    return {i: least[of[f]] for i, f in pairs}


def brute(rows):
    signed = [(i, brute_fingerprint(t)) for i, t in rows]
    component = brute_components([(i, f) for i, f in signed if i is not None])
    return sorted(((i, f"{f:016x}", component.get(i)) for i, f in signed), key=str)


def rows_of(df):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in df.collect()), key=str)


def test_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    assert rows_of(queries()["op11_simhash"](spark, data)) == brute([tuple(r) for r in docs])


def test_nulls_blanks_ties_and_long_texts(spark, tiny, nothing):
    more = tiny.selectExpr("*", "1 AS fp", "2 AS key", "3 AS node", "4 AS component", "5 AS fingerprint").repartition(3)
    assert rows_of(simhash.near_duplicates(more)) == brute([(r.doc_id, r.text) for r in tiny.collect()])
    assert simhash.near_duplicates(nothing).collect() == []


def test_spark_hashes_words_alike(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("größe zwei drei"))).first()[0] % 2**64 == xxhash.xxh64_intdigest("größe zwei drei".encode(), 42)


def crowded(n=700):
    """Fingerprints in chains and clouds around a few, zero among them, and as many at random."""
    rng = random.Random(5)
    out = [0, 1, 2**64 - 1]
    for base in (0, rng.getrandbits(64), rng.getrandbits(64)):
        for _ in range(n // 3):
            out.append(base ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(1, 6))}))
    for base in (rng.getrandbits(64),):
        for _ in range(60):  # a chain of steps of three bits
            base ^= sum({1 << b for b in rng.sample(range(64), 3)})
            out.append(base)
    return sorted({*out, *(rng.getrandbits(64) for _ in range(n))})


@pytest.mark.parametrize("most", [4096, 3])
def test_links_of_crowded_lists(spark, monkeypatch, most):
    from quadrant.llm.graphs import components

    monkeypatch.setattr(simhash, "LIST", most)
    fps = crowded(300)
    signed = [(f - 2**64 if f >= 2**63 else f, k) for k, f in enumerate(fps)]
    random.Random(1).shuffle(signed)
    # the driver's limit decides which lists are divided; workers keep their own, and so tally what is left
    classes = spark.createDataFrame(signed, "fp long, node long")
    want = brute_components(list(enumerate(fps)))
    got = dict(components(simhash.links(classes)).collect())
    assert {k: got.get(k, k) for k in range(len(fps))} == want


@pytest.mark.parametrize("level", [1, 2, 3, 4])
def test_lists_of_every_level_cover_near_pairs(level):
    """Two fingerprints that differ in three bits share a list of each level."""
    import pandas as pd

    rng = random.Random(level)
    for _ in range(40):
        a = rng.getrandbits(64)
        pair = np.array([a, a ^ sum(1 << b for b in rng.sample(range(64), 3))], np.uint64)
        keys = [pd.DataFrame({"key": [(k << 16) | (int(f) >> 16 * k & 0xFFFF) for f in pair for k in range(4)], "fp": np.repeat(pair.view(np.int64), 4), "node": np.repeat([0, 1], 4)})]
        for k in range(1, level):
            keys = list(simhash._divided(k)(iter(keys)))
        both = pd.concat(keys)
        assert set(both.key[both.node == 0]) & set(both.key[both.node == 1])


def test_lookups_and_tallies_agree():
    rng = np.random.default_rng(2)
    path = (1, 4, 2, 3)
    base = np.uint64(rng.integers(0, 1 << 63))
    open_ = simhash._rest(path[:3])
    x = rng.choice(1 << 18, 300, replace=False).astype(np.uint64)
    three = (x >> np.uint64(18)) << np.uint64(18) | x  # the six bits of piece 3 stay zero
    fp = np.full(300, base)
    for k, p in enumerate(reversed(open_)):
        fp = (fp & ~np.uint64(255 << 8 * p)) | (((three >> np.uint64(8 * k)) & np.uint64(255)) << np.uint64(8 * p))
    one, two = simhash._looked_up(fp, path, np.arange(300)), simhash._tallied(fp, np.arange(300))
    a, b = simhash._small(fp, np.zeros(300), 300)
    assert (one == two).all() and (simhash._joined(a, b, 300) == two).all() and len(set(two)) < 300
