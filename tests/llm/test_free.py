"""Operators with Python inside: neighbours, packing, near-duplicates, language-model scores, toxicity; graphs; the pipeline."""

import math
import random
import re
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quadrant.llm import bpe, lm_scoring, near_dedup, neighbours, packing, secrets, toxicity
from quadrant.llm.graphs import components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def groups_of(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("kind", ["path", "star", "random", "none"])
def test_components(spark, kind):
    rng = random.Random(1)
    pairs = {"path": [(k, k + 1) for k in range(60)], "star": [(90, k) for k in range(60)], "random": [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)] + [(200, 200)], "none": []}[kind]
    nodes = {x for p in pairs for x in p}
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == groups_of(pairs, nodes)


# neighbours


def recall_of(x, ids, got, k=20):
    """Share of the true k nearest, by brute force, among those found; scores and order are checked too."""
    found = defaultdict(list)
    for r in got:
        found[r.query_id].append((r.vec_id, r.score))
    hits = total = 0
    for q in np.nonzero(ids % 20 == 0)[0]:
        s = (x * x[q]).sum(1)
        s[q] = -np.inf
        best = ids[np.lexsort((ids, -s))[:k]]
        mine = found[ids[q]]
        hits, total = hits + len(set(best.tolist()) & {i for i, _ in mine}), total + min(k, len(ids) - 1)
        assert all(math.isclose(v, s[np.searchsorted(ids, i)]) for i, v in mine)
        assert len(mine) == min(k, len(ids) - 1) and [(-v, i) for i, v in mine] == sorted((-v, i) for i, v in mine)
    return hits / total


def test_recall_on_whole_table(spark, data):
    rows = spark.read.parquet(f"{data}/embeddings.parquet").orderBy("vec_id").collect()
    x, ids = np.array([r.embedding for r in rows], float), np.array([r.vec_id for r in rows])
    assert recall_of(x, ids, neighbours.op2_neighbours(spark, data).orderBy("query_id", "rank").collect()) >= 0.9


@pytest.mark.parametrize("lengths", ["one", "many"])
def test_recall_where_few_rows_are_verified(spark, tmp_path, lengths):
    """20,000 rows in two blocks, vectors of no structure at all, of one length and of many."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((20_000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    x *= np.float32(1) if lengths == "one" else rng.uniform(0.5, 1.5, (len(x), 1)).astype(np.float32)
    ids = np.arange(len(x))
    import pandas as pd

    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    frame = spark.createDataFrame(pd.DataFrame({"vec_id": ids, "embedding": list(x)}), "vec_id long, embedding array<float>")
    spark.conf.unset("spark.sql.execution.arrow.pyspark.enabled")
    got = neighbours.nearest(frame, F.col("id") % 20 == 0).orderBy("query_id", "rank").collect()
    assert recall_of(x.astype(float), ids, got) >= 0.95
    x = x.astype(float)
    longest = np.sqrt((x**2).sum(1).max())
    index = neighbours.Index(x[:10_000], *neighbours.fitted(x[:2000], longest), longest)
    verified = [n for *_, n in index.search(ids[:10_000], ids[:200], x[:200], 20)]
    assert np.mean(verified) <= 0.2 * 10_000


def test_neighbours_edges(spark):
    rng = np.random.default_rng(2)
    rows = [(k, rng.normal(size=8).tolist()) for k in range(300)] + [(400 + k, [3.0] * 8) for k in range(30)]
    rows += [(500, None), (501, []), (502, [0.0] * 8), (503, [float("nan")] * 8), (504, [1.0] * 7 + [None]), (505, [float("inf")] * 8), (506, [1.0] * 3), (None, [1.0] * 8), (400, [3.0] * 8), (0, [-9.0] * 8)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1)).withColumn("v", F.lit(0))
    got = neighbours.nearest(frame, F.col("id").isin(400, 0, 502, 506)).orderBy("query_id", "rank").collect()
    assert {r.query_id for r in got} == {0, 400} and not {r.vec_id for r in got} & {500, 501, 502, 503, 504, 505, 506}
    assert [r.vec_id for r in got if r.query_id == 400] == list(range(401, 421)) and {r.score for r in got if r.query_id == 400} == {72.0}
    assert neighbours.nearest(frame.limit(0), F.col("id") >= 0).count() == 0
    assert neighbours.nearest(frame.where("vec_id IN (1, 2)"), F.col("id") == 1).count() == 1


# packing


def test_words_equal_the_library():
    words = packing.Words(packing.default_vocabulary())
    rng = random.Random(3)
    pool = string.ascii_letters + "éüñßÇØøœßŁ" + string.digits + ".,!?;:'\"-()"
    new = list({"".join(rng.choices(pool, k=rng.randint(1, 14))) for _ in range(4000)} | {"".join(rng.choices("aeinorst", k=rng.randint(1, 20))) + rng.choice(["", ".", ",", "!!"]) for _ in range(4000)})
    new += ["Σας", "İx", "<|endoftext|>", "x<|endoftext|>.", "é", "ﬁn", "中文字", "日本語。", "x" * 60, "ſ", "ǅ", "'s", "don't", "it's."]
    new += ["a" * 47 + "é", "É" * 24 + ".", "Ⱥ" * 24, "word" + "!" * 9, "...", "", "a\xa0b", "a\x1cb", "ﬀ", "ǅx,"]
    import pyarrow as pa

    whole = [" ".join(rng.choices(new, k=40)) for _ in range(50)] + ["", " ", "  lead", "trail \n", "\u2003wide\u2003space"]
    for texts in (new, whole):
        got = [ids.tolist() for ids in words.ids(pa.array(texts, pa.string()))]
        assert got == [e.ids for e in words.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert bpe.plain(pa.array(new))[0].sum() > 4000
    one_by_one = packing.Words(packing.default_vocabulary())
    one_by_one.merges = None  # another vocabulary: all by the library
    assert [ids.tolist() for ids in one_by_one.ids(pa.array(whole))] == got


def brute_pieces(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_vocabulary())
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        for k, a in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[a : a + 4096], "<u4").tobytes()
            yield i, k, a, len(part) // 4, zlib.crc32(part)


def packed_well(rows, capacity=4096):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for s in by.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_query(spark, data):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    got = packing.op5_packing(spark, data).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == Counter(brute_pieces(rows))
    assert packed_well(got) <= -(-sum(r.length for r in got) // 4096) + 1


def test_packing_edges(spark, tiny, nothing):
    got = packing.pack(packing.pieces(tiny)).collect()
    want = Counter(brute_pieces([(r.doc_id, r.text) for r in tiny.collect()]))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    packed_well(got)
    assert packing.pack(packing.pieces(nothing)).count() == 0


def best_fit_decreasing(size, capacity=4096):
    bins, free = [], []
    packing.best_fit(bins, free, sorted(range(len(size)), key=lambda i: -size[i]), size, capacity)
    return len(bins)


def test_cells_join_and_reruns_agree(spark):
    rng = random.Random(4)
    rows = [(k, 0, 0, rng.randint(1, 4000), k) for k in range(3000)]
    frame = spark.createDataFrame(rows, packing.PIECE).withColumn("island", F.lit("x"))
    got = packing.pack(frame, cell=200).collect()
    assert packed_well(got) <= 1.02 * best_fit_decreasing([r[3] for r in rows])
    key = lambda r: (r.doc_id, r.sequence_id, r.offset)
    assert sorted(map(key, got)) == sorted(map(key, packing.pack(frame.repartition(7), cell=200).collect()))


def test_evolution_beats_best_fit_on_hard_lengths(spark):
    """Lengths of about two and a half a sequence: fewer sequences than best-fit decreasing, in one cell and over many."""
    rng = random.Random(1)
    rows = [(k, 0, 0, rng.randint(900, 2100), k) for k in range(3000)]
    plain = best_fit_decreasing([r[3] for r in rows])
    frame = spark.createDataFrame(rows, packing.PIECE)
    assert packed_well(packing.pack(frame, cell=3000).collect()) < plain
    assert packed_well(packing.pack(frame, cell=500).collect()) <= plain


@pytest.mark.parametrize("lengths", [(2100, 4000), (900, 2100), (1, 4000)])
def test_no_cell_grows_where_nothing_fills(spark, monkeypatch, lengths):
    """Lengths that leave all bins unfilled, too: every level has bounded cells, and half of the pieces of the one before at most."""
    rng, levels, islands = random.Random(2), [], packing.islands

    def seen(rest, cells, level, capacity):
        found = [r["count"] for r in rest.groupBy("island").count().collect()]
        assert len(found) <= cells
        levels.append(found)
        return islands(rest, cells, level, capacity)

    monkeypatch.setattr(packing, "islands", seen)
    rows = [(k, 0, 0, rng.randint(*lengths), k) for k in range(3000)]
    n = packed_well(packing.pack(spark.createDataFrame(rows, packing.PIECE), cell=128).collect())
    plain = best_fit_decreasing([r[3] for r in rows])
    assert max(map(max, levels)) <= 2 * 128 and len(levels[-1]) == 1
    assert all(sum(b) <= sum(a) / 2 for a, b in zip(levels, levels[1:], strict=False))
    assert n <= 1.03 * plain  # cells of 128 pieces hold uneven shares of the long ones; see test_cells_join for 200


def test_crossovers_decide_on_the_given_data(spark, data):
    """Every island crosses, and some elite is fitter than its founders, on the driver's own documents."""
    rest = packing.pieces(spark.read.parquet(f"{data}/documents.parquet")).where("length < 4096").withColumn("island", F.col("doc_id") % 2)
    rows = packing.islands(rest, 2).collect()
    assert len(rows) == 2 * packing.DEMES and all(r.crossovers == packing.EPOCHS * packing.GENERATIONS for r in rows)
    gains = 0
    for r in rows:
        size = np.frombuffer(r.size, "<i8").tolist()
        first = packing.fitness(packing.founders(size, 4096, 0)[0], 4096)
        assert (-r.bins, r.fill) >= first
        gains += (-r.bins, r.fill) > first
    assert gains > 0


def test_evolution_never_loses():
    for seed in range(5):
        rng = random.Random(seed)
        size = sorted((rng.randint(900, 2100) for _ in range(200)), reverse=True)
        first = packing.founders(size, 4096, seed)
        got = packing.evolve(first, size, 4096, seed)
        for bins, free in got:
            assert sorted(i for b in bins for i in b) == list(range(200)) and free == [4096 - sum(size[i] for i in b) for b in bins] and min(free) >= 0
            assert packing._read(packing._spelled((bins, free), 200), size, 4096)[1] == free
        worth = [packing.fitness(x, 4096) for x in got]
        assert worth == sorted(worth, reverse=True) and worth[0] >= max(packing.fitness(x, 4096) for x in first)
        assert len(first[0][0]) == best_fit_decreasing(size)


def hard(n):
    """Lengths of about two and a half a sequence, the largest first."""
    rng = random.Random(7)
    return sorted((rng.randint(900, 2100) for _ in range(n)), reverse=True)


def test_evolution_goes_on_until_nothing_is_gained(monkeypatch):
    """Not for a fixed number of crossovers: clearly fewer sequences than best fit gives, and a child of them hardly ever helps."""
    size, made, cross = hard(512), [], packing._cross
    monkeypatch.setattr(packing, "_cross", lambda *a: made.append(cross(*a)) or made[-1])
    got = packing.evolve(packing.founders(size, 4096, 1), size, 4096, 1)
    assert len(got[0][0]) <= 0.98 * best_fit_decreasing(size)
    best = packing.fitness(got[0], 4096)
    assert len(made) > 500 and all(packing.fitness(x, 4096) < best for x in made[-60:])
    easy = [64] * 640  # ten full sequences at once, which no crossover betters
    made.clear()
    assert len(packing.evolve(packing.founders(easy, 4096, 1), easy, 4096, 1)[0][0]) == 10 and 0 < len(made) < 100


def test_pipeline_packs_until_nothing_is_gained(spark, monkeypatch):
    size = hard(512)
    rows = spark.createDataFrame([(k, 0, 0, n, k) for k, n in enumerate(size)], packing.PIECE)
    monkeypatch.setattr(packing, "pieces", lambda docs: docs)
    assert packed_well(corpus_pipeline.pack_sequences(spark, rows, "").collect()) <= 0.98 * best_fit_decreasing(size)


# near-duplicates


def brute_components(rows):
    sets = {}
    for i, text in rows:
        w = WORD.findall((text or "").encode().lower())
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    ids = sorted(sets)
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    return {i: (len(sets[i]), c) for i, c in groups_of(pairs, ids).items()}


def copies(seed=5, groups=6, each=30):
    """Groups of near-copies on both sides of the threshold, chains among them."""
    rng = random.Random(seed)
    draw = lambda: "".join(rng.choices(string.ascii_letters, k=5))
    rows = []
    for _ in range(groups):
        base = [draw() for _ in range(rng.choice([60, 120, 200]))]
        for _ in range(each):
            own = list(base)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = draw()
            rows.append(" ".join(own))
            if rng.random() < 0.3:
                base = own
    rows += rows[:10] + [r.upper() for r in rows[10:20]] + ["one two three", "one two three", "one two", None, "", "  "]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("block", "pivots"), [(None, 2), (16_000, 2), (16_000, 1), (None, 0)])
def test_near_duplicates_by_brute_force(spark, monkeypatch, block, pivots):
    """Whether pivots settle buckets or pairs of blocks do, in many blocks or one, links are the same."""
    monkeypatch.setattr(near_dedup, "PIVOTS", pivots)
    if block:
        monkeypatch.setattr(near_dedup, "BLOCK", block)
    rows = copies()
    got = {r.doc_id: r for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit(1)).withColumn("node", F.lit(1))).collect()}
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == brute_components(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_pipeline_stage_by_brute_force(spark):
    """Near copies at 0.8 and more go, those between 0.8 and 0.85 among them; those just below 0.8 stay."""
    rng = random.Random(8)
    draw = lambda: "".join(rng.choices(string.ascii_letters, k=5))
    rows = []
    for edits in (2, 3, 4, 4, 5, 6):
        for _ in range(12):
            base = [draw() for _ in range(204)]  # 200 shingles, of which an edit takes 5
            own = list(base)
            for k in range(edits):
                own[10 + 20 * k] = draw()
            rows += [" ".join(base), " ".join(own)]
    rng.shuffle(rows)
    sets = []
    for text in rows:
        w = text.lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)})
    alike = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in range(len(sets)) for b in range(a)}
    assert sum(0.8 <= s < 0.85 for s in alike.values()) >= 20 and sum(0.7 <= s < 0.8 for s in alike.values()) >= 20
    found = groups_of([p for p, s in alike.items() if s >= 0.8], range(len(rows)))
    docs = spark.createDataFrame([(k, t, "en", "a", len(t)) for k, t in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert got.columns == docs.columns and {r.doc_id for r in got.collect()} == set(found.values())


def test_bands_fit_the_threshold():
    for percent in (70, 80, 85, 90):
        r = near_dedup.band_rows(percent)
        assert (1 - (percent / 100) ** r) ** (128 // r) <= 1e-4
    assert near_dedup.band_rows(85) == 6 and near_dedup.band_rows(80) == 5


def test_near_duplicates_edges(spark, tiny, nothing):
    got = near_dedup.near_duplicates(tiny).collect()
    assert len(got) == tiny.count() and near_dedup.near_duplicates(nothing).count() == 0
    by = {r.doc_id: r for r in got}
    assert by[2].component_id == 1 and by[3].component_id == 1 and not by[2].kept and by[1].kept
    assert all(by[k].n_shingles == 0 and by[k].kept for k in (4, 5, 6)) and by[None].kept and by[None].component_id is None
    assert by[9].n_shingles == 1


# language-model scores


def test_scores(spark, data):
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    words = {i: [*WORD.findall(t.encode().lower()), b""] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in words}
    c = Counter(w for i, ws in words.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    got = {r.doc_id: r for r in lm_scoring.op8_lm_scoring(spark, data).collect()}
    assert len(got) == len(rows)
    for i, ws in words.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws))
        size = len((dict(rows)[i]).encode())
        assert r.score < 0 and r.bits == pytest.approx(-r.score * math.log2(10)) and r.bits_per_byte == pytest.approx(r.bits / max(1, size))


def vocabulary_of(n=300, seed=4):
    """Hashes, and times by class, of n known words, some seen once."""
    rng = np.random.default_rng(seed)
    times = np.floor(rng.pareto(0.8, (n, lm_scoring.KINDS)) * (rng.random((n, lm_scoring.KINDS)) < 0.4))
    times[times.sum(1) == 0, 0] = 1
    return rng.integers(0, 1 << 64, n, dtype=np.uint64, endpoint=False), times


def packed(words, hashes, times):
    """The share of these words from two blocks, packed and read back; given hashes for their own."""
    import pandas as pd

    squeeze = lambda x: zlib.compress(np.ascontiguousarray(x).tobytes())
    half = (times // 2).astype("<i8")
    blocks = [{"share": 0, "block": b, "words": zlib.compress(b" ".join(words)), "times": squeeze(t), "idx": squeeze(np.arange(len(words), dtype="<i4"))} for b, t in ((5, half), (6, times.astype("<i8") - half))]
    row = next(lm_scoring._merge(pd.DataFrame(blocks)).itertuples(index=False))
    share = lm_scoring.Share(row)
    own = np.frombuffer(zlib.decompress(row.own), "<i4").reshape(2, -1)
    assert sorted(words) == share.words and (own[0] == own[1]).all() and [share.words[i] for i in own[0]] == words and (share.times[own[0]] == times).all()
    share.words, share.hashes, share.times, share.count = words, hashes.astype(np.uint64), share.times[own[0]], share.count[own[0]]
    return share


def some_mixer(seed=5):
    rng = np.random.default_rng(seed)
    return rng.normal(0.4, 0.1, (lm_scoring.TREE_GATES, lm_scoring.VIEWS)).astype(np.float32), rng.uniform(0.2, 0.8, lm_scoring.TREE_GATES * lm_scoring.BUCKETS)


def brute_tree(hashes, times, mixer):
    """Each word's log10 probability by class, walking down from the root with all words at hand."""
    out = np.zeros((len(hashes), lm_scoring.KINDS))
    for w, h in enumerate(hashes.tolist()):
        for level in range(64):
            under = [k for k, o in enumerate(hashes.tolist()) if o >> (64 - level) == h >> (64 - level)]
            if len(under) == 1:
                break
            one = [k for k in under if hashes[k].item() >> (63 - level) & 1]
            zero = [k for k in under if k not in one]
            if not one or not zero:
                continue
            bit = h >> (63 - level) & 1
            n0, n1 = ([times[ks].sum(), *times[ks].sum(0)] for ks in (zero, one))
            odds = [math.log((b + 0.4) / (a + 0.4)) for a, b in zip(n0, n1)]
            for g in range(lm_scoring.KINDS):
                gate = g * (len(lm_scoring.SEEN) + 1) + sum(n0[g + 1] + n1[g + 1] >= s for s in lm_scoring.SEEN)
                z = sum(float(a) * b for a, b in zip(mixer[0][gate], odds))
                slot = min(max(round(z * 2 + lm_scoring.BUCKETS // 2), 0), lm_scoring.BUCKETS - 1)
                p = (1 / (1 + math.exp(-z)) + mixer[1][gate * lm_scoring.BUCKETS + slot]) / 2
                out[w, g] += math.log10(p if bit else 1 - p)
    return out


@pytest.mark.parametrize("bits", [0, 3])
def test_tree_by_brute_force(bits):
    """The same costs from one bucket or from eight, those of a plain walk; by class, all words together have chance 1."""
    hashes, times = vocabulary_of()
    mixer, bucket = some_mixer(), (hashes >> np.uint64(61)).astype(int) if bits else np.zeros(len(hashes), int)
    top = np.array([times[bucket == b].sum(0) for b in range(1 << bits)])
    got = np.zeros(times.shape)
    for b in range(1 << bits):
        got[bucket == b] = lm_scoring.tree_costs(lm_scoring.Tree(hashes[bucket == b], times[bucket == b], b, top), mixer)
    assert got == pytest.approx(brute_tree(hashes, times, mixer), abs=1e-6)
    assert (10**got).sum(0) == pytest.approx(np.ones(lm_scoring.KINDS))


def test_next_token_probabilities_sum_to_one():
    """After any beginning of a text: known words along the tree or spelled, and all else spelled."""
    hashes, times = vocabulary_of(100)
    mixer, new = some_mixer(), np.linspace(0.05, 0.3, lm_scoring.KINDS)
    rng = np.random.default_rng(6)
    spelled = np.log10(rng.dirichlet(np.ones(101)) * 0.7)  # 101 words take 0.7 of what is spelled, all others 0.3
    share = packed([b"w%d" % k for k in range(101)], np.append(hashes, 7), np.append(times, np.zeros((1, lm_scoring.KINDS)), 0))
    price = lm_scoring.priced(share, spelled, 0, times.sum(0, keepdims=True), mixer, new)
    assert (10**price).sum(0) + 0.3 * new == pytest.approx(np.ones(lm_scoring.KINDS), abs=1e-5)
    shares = times.sum(0) / times.sum()
    for text in ([], [3], [5, 5, 100, 7], rng.integers(0, 101, 60).tolist()):
        total = sum(10 ** lm_scoring.mixed(np.append(price[text], [row], 0), shares)[-1] for row in [*price, np.log10(0.3 * new)])
        assert total == pytest.approx(1, abs=1e-5)


def test_scores_whatever_the_partitions(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    a, b = ({r.doc_id: r.score for r in lm_scoring.score(x, lm_scoring.held_out(F.col("doc_id"))).collect()} for x in (docs, docs.repartition(5, "text")))
    assert a == {i: pytest.approx(s, rel=1e-5) for i, s in b.items()}


def test_spelling_is_a_probability():
    """The costs of all 256 next bytes, whatever the model, sum to 1; and words cost alike alone and in a batch."""
    rng = np.random.default_rng(1)

    class Model:
        value = rng.integers(0, 50, (lm_scoring.OFFSETS[-1], 2)).astype(np.float32)

    mixer = (rng.normal(0.3, 0.1, (lm_scoring.GATES, lm_scoring.CONTEXTS)).astype(np.float32), rng.uniform(0.1, 0.9, 256 * lm_scoring.BUCKETS))
    cost = lambda words: lm_scoring.spelling_costs(Model.value, mixer, words)
    bytes_ = [bytes([k]) for k in range(256)]
    words = [b"", b"a", b"ab", b"abc", b"abd", b"b" * 100, "é".encode(), b"abc"]
    assert cost(words) == pytest.approx([cost([w])[0] for w in words])
    # the tree of all bytes after a beginning: exact sum of probabilities
    grown = {}
    for i, rows, _, slots, c0, bit in lm_scoring.Coder([b"q" + c for c in bytes_]).bits():
        odds, amount = lm_scoring._odds(Model.value, slots)
        z = np.einsum("ok,ko->k", odds, mixer[0][lm_scoring._gate(amount, i == 0)])
        p = np.clip((lm_scoring._squash(z) + mixer[1][c0.astype(np.int64) * lm_scoring.BUCKETS + lm_scoring._bucket(z)]) / 2, 1e-5, 1 - 1e-5)
        if i == 1:
            for r, v in zip(rows.tolist(), np.where(bit, p, 1 - p), strict=True):
                grown[r] = grown.get(r, 1.0) * v
    assert len(grown) == 256 and sum(grown.values()) == pytest.approx(1)


def test_contexts_are_of_whole_words():
    """The slots of every byte's first bit, by brute force: nothing begins afresh, however long the word."""
    rng = random.Random(9)
    long = "".join(rng.choices(string.ascii_letters, k=150)).encode()
    words = [long, long[:40], long[:70] + b"z" * 30, b"a", "é".encode() * 200, b"x" * 5000]
    mask, golden = (1 << 64) - 1, int(lm_scoring.GOLDEN)
    want = {}
    for w in words:
        prefix, w = golden, w + b" "
        for i in range(len(w)):
            slots = []
            for o, c in enumerate([0, *(int.from_bytes(w[max(0, i - k) : i], "big") for k in (1, 2, 3, 4)), prefix]):
                h = ((((c + o) * golden) & mask) ^ 1) * int(lm_scoring.MULTIPLIERS[o]) & mask
                h ^= h >> 29
                slots.append(((h * golden & mask) >> (68 - lm_scoring.SLOT_BITS[o])) * 16 + 1 + int(lm_scoring.OFFSETS[o]))
            want[w[: i + 1]] = tuple(slots)  # once for each beginning
            prefix = (prefix ^ (w[i] + 1)) * golden & mask
            prefix ^= prefix >> 27
    got = Counter()
    for _, _, weight, slots, c0, _ in lm_scoring.Coder(words).bits():
        if c0[0] == 1:
            for k, s in enumerate(map(tuple, slots.T.tolist())):
                got[s] += weight[k]
    times = Counter()
    for w in words:
        times.update(want[(w + b" ")[: i + 1]] for i in range(len(w) + 1))
    assert got == times


def test_two_passes_of_learning():
    words = [b"alpha", b"beta", b"y" * 100]
    seen = np.zeros((lm_scoring.OFFSETS[-1], 2), np.float32)
    steps = list(lm_scoring._spelling_steps(seen, words))
    value = lm_scoring._online(steps, np.full((lm_scoring.GATES, lm_scoring.CONTEXTS), 0.3, np.float32), lm_scoring.RATE, 256).value.to_numpy()
    heard = value[lm_scoring.GATES * lm_scoring.CONTEXTS :][: lm_scoring.GATES]
    assert heard.sum() == 2 * 8 * sum(len(w) + 1 for w in words)
    hashes, times = vocabulary_of()
    tree = lm_scoring.Tree(hashes, times, 0, times.sum(0, keepdims=True))
    value = lm_scoring._online(list(lm_scoring._tree_steps(tree)), lm_scoring._tree_first(), lm_scoring.TREE_RATE, lm_scoring.TREE_GATES).value.to_numpy()
    weights, heard = value[: lm_scoring.TREE_GATES * lm_scoring.VIEWS], value[lm_scoring.TREE_GATES * lm_scoring.VIEWS :][: lm_scoring.TREE_GATES]
    count = tree.times.sum(1)
    assert heard.sum() == 2 * sum(count[rows][count[rows] > 1].sum() for rows, *_ in tree.nodes())
    assert np.abs(weights - (lm_scoring._tree_first() * heard[:, None]).ravel()).max() > 0


def brute_before(text, chance, word=None):
    """(cells of the two bits, chance of the next word given its chance without them as a function) after each beginning."""
    out = []
    for t in range(len(text)):
        tries = []
        for order in (2, 1):
            context = lambda i: tuple(text[i - k] if i >= k else None for k in range(1, order + 1))  # noqa: B023, E731
            came = lambda upto: [i for i in range(upto) if context(i) == context(upto)]  # noqa: B023, E731
            guess = lambda i: text[came(i)[-1]] if came(i) else None  # noqa: B023, E731
            mine = [i for i in came(t) if guess(i) is not None]
            every = [i for i in range(t) if guess(i) is not None]
            odds = [min(max(round(math.log((r + 0.4) / (len(x) - r + 0.4))), -6), 6) + 6 for x in (mine, every) for r in [sum(guess(i) == text[i] for i in x)]]
            tries.append((guess(t), *odds, sum(len(mine) >= k for k in lm_scoring.TRIED)))
        (two, own2, all2, n2), (one, own1, all1, n1) = tries
        cell = lambda kind, flag, n, own, other, every: ((((kind * 2 + flag) * 4 + n) * 13 + own) * 13 + other) * 13 + every
        a = None if two is None else cell(0, one == two, n2, own2, own1 if one == two else 6, all2)
        b = None if one is None or one == two else cell(1, two is not None, n1, own1, own2 if two is not None else 6, all1)

        def whole(w, p, a=a, b=b, two=two, one=one):
            if b is not None:
                p = (1 - chance[b]) * p + chance[b] * (w == one)
            return p if a is None else (1 - chance[a]) * p + chance[a] * (w == two)

        out.append((a, b, whole))
    return out


def test_words_before_by_brute_force():
    """Cells, counts and chances of the bits of words before; chances of all next words still sum to 1."""
    import pandas as pd

    rng = np.random.default_rng(8)
    texts = [[0], [1, 1, 1, 1, 0], [2, 3, 4, 2, 3, 4, 2, 3, 5, 0], *[[*rng.integers(1, 4, 40).tolist(), 0] for _ in range(4)]]
    chance, plain = rng.uniform(0.05, 0.6, lm_scoring.CELLS), rng.dirichlet(np.ones(6))
    tokens, sizes = np.concatenate(texts).astype("<i4"), list(map(len, texts))
    got = lm_scoring.with_words_before(np.log10(plain[tokens]), tokens, sizes, chance)
    want, times = [], Counter()
    for text in texts:
        for w, (a, b, whole) in zip(text, brute_before(text, chance), strict=True):
            assert sum(whole(v, plain[v]) for v in range(6)) == pytest.approx(1)
            want.append(math.log10(whole(w, plain[w])))
    for text in texts:
        for t, (a, b, _) in enumerate(brute_before(text, chance)):
            yes = lambda order: text[max(i for i in range(t) if i >= 0 and [text[i - k] if i >= k else None for k in range(1, order + 1)] == [text[t - k] if t >= k else None for k in range(1, order + 1)])] == text[t]  # noqa: B023, E731
            hit = a is not None and yes(2)
            if a is not None:
                times[a, hit] += 1
            if b is not None and not hit:
                times[b, yes(1)] += 1
    assert got == pytest.approx(np.array(want))
    row = pd.DataFrame({"idx": [zlib.compress(np.array(t, "<i4").tobytes()) for t in texts]})
    found = next(lm_scoring._count_before(iter([row])))
    assert {(r.cell, h): k for r in found.itertuples() for h, k in ((True, r.yes), (False, r.n - r.yes)) if k} == times


def test_order_of_words_counts(spark):
    """A text that says sentences again scores better than its words in any order."""
    rng = random.Random(12)
    words = ["".join(rng.choices(string.ascii_lowercase, k=5)) for _ in range(300)]
    rows = []
    for k in range(200):
        said = rng.sample(words, 30) * 3
        rows.append((2 * k, " ".join(said)))
        rows.append((2 * k + 1, " ".join(rng.sample(said, len(said)))))
    got = lm_scoring.score(spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string"), F.col("doc_id") % 10 >= 8).where("held_out").collect()
    by = {r.doc_id: r.score for r in got}
    assert all(by[i] > by[i + 1] + 10 for i in by if i % 2 == 0) and len(by) == 80


def test_counting_bits_takes_little_more_than_its_table(monkeypatch):
    """Counts are added in place; as sums over all slots for some words they took five times the table."""
    import tracemalloc

    class Some:
        trained = [b"w%d" % k for k in range(2000)] + [b"w7x"]

    monkeypatch.setattr(lm_scoring, "_shares", lambda batches: iter([Some]))
    tracemalloc.start()
    found = list(lm_scoring._count(iter([])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = np.zeros(2 * lm_scoring.OFFSETS[-1])
    for _, _, weight, slots, _, bit in lm_scoring.Coder(Some.trained).bits():
        want += np.bincount((2 * slots + bit).ravel(), np.broadcast_to(weight, slots.shape).ravel(), len(want))
    got = np.zeros(len(want))
    for f in found:
        part = np.frombuffer(zlib.decompress(f.counts.iat[0]), "<f4")
        got[f.chunk.iat[0] * lm_scoring.CHUNK :][: len(part)] = part
    assert (got == want).all() and peak < 2 * 4 * len(want)


def test_scores_beat_the_base_on_new_texts(spark):
    rng = random.Random(6)
    parts = {"en": ["th", "er", "ing", "on", "an", "re"], "de": ["sch", "ei", "en", "ung", "zu", "au"]}
    rows = []
    for k in range(400):
        lang = "en" if k % 2 else "de"
        rows.append((k, " ".join("".join(rng.choices(parts[lang], k=rng.randint(1, 4))) for _ in range(60)), lang))
    got = lm_scoring.score(spark.createDataFrame(rows, "doc_id long, text string, lang string"), lm_scoring.held_out(F.col("doc_id"))).where("held_out").collect()
    assert sum(r.score > r.base_score for r in got) > 0.95 * len(got)


def test_scores_edges(tiny, nothing):
    got = lm_scoring.score(tiny.withColumn("score", F.lit(1)), lm_scoring.held_out(F.col("doc_id"))).collect()
    assert len(got) == tiny.count()
    by = {r.doc_id: r for r in got}
    assert by[4].n_tokens == by[5].n_tokens == by[6].n_tokens == 1 and by[9].n_tokens == 30001 and by[4].score == by[5].score
    assert lm_scoring.score(nothing, F.lit(False)).count() == 0
    assert all(r.score < 0 for r in lm_scoring.score(tiny, F.lit(True)).collect())  # nothing to learn from


# toxicity


def insults(n=600, seed=7):
    rng = random.Random(seed)
    plain, bad = ["table", "river", "green", "walks", "house", "music", "seven", "paper"], ["vilefoo", "nastybar", "grimbaz"]
    rows, labels = [], []
    for k in range(n):
        toxic = int(k % 5 == 0)
        words = rng.choices(plain, k=30) + (rng.choices(bad, k=1) if toxic else []) + (["women"] if k % 5 == 0 and k % 2 == 0 or rng.random() < 0.05 else [])
        rng.shuffle(words)
        rows.append((k, " ".join(words)))
        labels.append((k, toxic))
    return rows, labels


def test_counterfactuals_on_the_given_data(spark, monkeypatch):
    """Real documents are swapped, and what a swap moves falls by the counterfactual term."""
    data = "/root/testdata/sf0.01"
    docs, marks = (spark.read.parquet(f"{data}/{x}.parquet") for x in ("documents", "labels"))
    chosen, rows = toxicity.prepare(docs, marks.select("doc_id", "toxic"), ~toxicity.held_out(F.col("doc_id")))
    pairs = [(set(a), set(b)) for a, b in zip(rows.x, rows.other) if b is not None]
    assert len(pairs) > 0.5 * len(rows) and sum(a != b for a, b in pairs) > 0.5 * len(pairs)

    def change():
        w, _ = toxicity.fit(rows, len(chosen))
        return np.mean([abs(w[list(a - b)].sum() - w[list(b - a)].sum()) for a, b in pairs])

    fair = change()
    monkeypatch.setattr(toxicity, "COUNTERFACTUAL", 0.0)
    assert fair < 0.5 * change()


def test_toxicity_query(spark):
    """The query's columns, and recall and false alarms on labels that it hasn't seen."""
    data = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    got = {r.doc_id: r for r in toxicity.op10_toxicity(spark, data).collect()}
    assert len(got) == spark.read.parquet(f"{data}/documents.parquet").count()
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    seen = [(truth[i], r.predicted) for i, r in got.items() if r.held_out and i in truth]
    assert sum(p for t, p in seen if t) >= 0.85 * sum(t for t, _ in seen) and sum(p for t, p in seen if not t) <= 0.02 * sum(1 - t for t, _ in seen)


def test_held_out_accuracy(spark):
    rows, labels = insults()
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, marks, ~toxicity.held_out(F.col("doc_id")))
    truth = dict(labels)
    got = toxicity.score(docs, model).where(toxicity.held_out(F.col("doc_id"))).collect()
    assert sum((r.score >= toxicity.THRESHOLD) == bool(truth[r.doc_id]) for r in got) > 0.95 * len(got)


def test_counterfactual_loss_keeps_names_neutral(spark, monkeypatch):
    rows, labels = insults()
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    mention = spark.createDataFrame([(1, "table women river"), (2, "table men river")], "doc_id long, text string")

    def gap():
        a, b = (r.score for r in toxicity.score(mention, toxicity.train(docs, marks, F.lit(True))).orderBy("doc_id").collect())
        return a - b

    fair = gap()
    monkeypatch.setattr(toxicity, "COUNTERFACTUAL", 0.0)
    assert abs(fair) < 0.5 * abs(gap())


def test_toxicity_edges(spark, tiny, nothing):
    marks = spark.createDataFrame([(1, 0), (1, None), (3, 1), (7, 0), (None, 1), (999, 1)], "doc_id long, toxic int")
    model = toxicity.train(tiny, marks, F.lit(True))
    got = toxicity.score(tiny.withColumn("toxic", F.lit("x")), model, ("text", "lang")).collect()
    assert len(got) == tiny.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(nothing, model).count() == 0
    empty = toxicity.train(nothing, marks.limit(0), F.lit(True))
    assert all(0 <= r.score <= 1 for r in toxicity.score(tiny, empty).collect())


# the pipeline


def test_stages_and_columns(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "secrets", "mixing", "packing"] and corpus_pipeline.ORACLE_SQL is None
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, seen = seen, stage(spark, seen, data).cache()
        assert seen.columns == docs.columns
        if name == "secrets":
            assert seen.count() == before.count()
            assert secrets.scan(seen).where(F.size("base") > 0).count() == 0
    mixed = Counter((r.doc_id, r.text) for r in seen.collect())
    assert max(mixed.values()) <= 2
    got = corpus_pipeline.STAGES[-1][1](spark, seen, data).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == Counter(x for (i, t), n in mixed.items() for _ in range(n) for x in brute_pieces([(i, t)]))
    packed_well(got)


def test_pipeline_edges(spark, tiny, nothing, data):
    clash = {c: F.lit(77) for c in ("size", "score", "base", "spans", "hash", "target", "source_size", "taken", "copies", "copy", "redacted", "kept", "found", "scan_text", "a.b`c", "column 1")}
    for docs in (tiny.withColumns(clash), nothing):
        seen = docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            seen = corpus_pipeline.written(stage(spark, seen, data), f"test-{name}")
            assert seen.columns == docs.columns
            assert all(r[c] == 77 for r in seen.collect() for c in clash if c in seen.columns)
        assert corpus_pipeline.STAGES[-1][1](spark, seen, data).count() >= 0


def test_repeated_rows_leave_one(spark, tiny):
    rows = tiny.unionByName(tiny).unionByName(tiny.where("doc_id = 11").withColumn("text", F.lit("another text under the same id")))
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, rows, "").collect())
    assert 2 not in {i for i, _ in got} and all(n == 1 for (i, _), n in got.items() if i is not None)
    assert sum(n for (i, _), n in got.items() if i == 11) == 2 and sum(n for (i, _), n in got.items() if i is None) == 2


def test_pipeline_run(spark, data):
    """run() is its stages one after another."""
    got = corpus_pipeline.run(spark, data)
    docs = {r.doc_id: r for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = got.collect()
    assert {r.doc_id for r in rows} <= docs.keys() and len({r.doc_id for r in rows}) > 0.5 * len(docs)
    packed_well(rows)
    assert len(rows) == len({(r.sequence_id, r.offset) for r in rows})
