"""Toxicity by a counterfactually regularised classifier.

A text's features are the presence of its words and of their beginnings, so a stem counts under any ending. Counts over
the labelled sample choose the features that tell the classes apart, and those of identity terms; a logistic regression is
fitted on them. For every labelled text that holds an identity term, the same text with its terms swapped is made, and the
square of the change in its log odds is part of the loss: a term alone then moves no score, and neutral mentions stay
neutral.

Identity terms are those of IDENTITIES, and what the sample itself shows to be alike: words that many texts hold, toxic or
not, and that stand among the same other words, so that one may stand for the other. That gives pairs in whatever
languages the texts are.

The fit uses at most SAMPLE labelled rows, those with the least hash of their id. Scoring covers all rows, one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrant.llm.common import released, table, written

SAMPLE, THRESHOLD = 20_000, 0.3
SLOTS, PREFIXES = 1 << 22, (4, 5, 6)
#: A feature is chosen if its chi-squared over the labelled sample is this high, the highest CHOSEN at most.
LEAST_CHI2, CHOSEN = 20.0, 8192
RIDGE, COUNTERFACTUAL, STEPS = 1e-4, 1.0, 400
#: Groups of names that may stand for each other; the last of each is neutral.
IDENTITIES = (("women", "men", "girls", "boys", "people"), ("woman", "man", "girl", "boy", "person"), ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "religious"), ("black", "white", "asian", "latino", "african", "european"), ("gay", "lesbian", "straight", "transgender", "bisexual", "single"), ("immigrants", "refugees", "foreigners", "natives", "residents"), ("disabled", "deaf", "blind", "elderly", "young", "adult"))
#: Learned terms: at most so many, each in so large a share of the sample, of a chi-squared below this; how alike a pair's
#: company must be (cosine), and how many times as frequent one may be.
TERMS, LEAST_SHARE, NEUTRAL_CHI2, ALIKE, RATIO = 128, 0.01, 1.0, 0.9, 2.0
#: Words that a worker remembers as telling nothing, and counts before it hands them on.
CACHE, COUNTED = 200_000, 100_000
LETTERS = bytes.maketrans(bytes(range(65, 91)) + b"".join(bytes([c]) for c in range(128) if not chr(c).isalnum()), bytes(range(97, 123)) + b" " * sum(not chr(c).isalnum() for c in range(128)))

def words_of(text: str | None) -> set[bytes]:
    """The distinct words: runs of letters, digits and anything beyond ASCII, A-Z lower-cased."""
    return set(text.encode("utf-8", "surrogatepass").translate(LETTERS).split()) if isinstance(text, str) else set()


def slots_of(word: bytes) -> tuple[int, ...]:
    """The hashed features of a word: itself, and its first PREFIXES characters."""
    text = word.decode("utf-8", "replace")
    names = [b"=" + word] + [b"^" + text[:k].encode() for k in PREFIXES if len(text) >= k]
    return tuple(xxhash.xxh3_64_intdigest(x) % SLOTS for x in names)


def turns(identities) -> dict[bytes, bytes]:
    """Each term's successor in its group; where groups share a term, the first counts."""
    out: dict[bytes, bytes] = {}
    for group in identities:
        for a, b in zip(group, group[1:] + group[:1], strict=True):
            out.setdefault(a.encode(), b.encode())
    return out


def swapped(words: set[bytes], turn: dict[bytes, bytes]) -> set[bytes] | None:
    """words with every identity term turned into its successor; None if there are none."""
    found = words & turn.keys()
    return (words - found) | {turn[w] for w in found} if found else None


def _frequent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How many clean and toxic rows hold each word."""
    seen: dict[bytes, list[int]] = {}
    for pdf in batches:
        for text, toxic in zip(pdf.text, pdf.toxic, strict=True):
            for w in words_of(text):
                seen.setdefault(w, [0, 0])[int(toxic)] += 1
            if len(seen) > COUNTED:
                yield _listed(seen)
                seen = {}
    yield _listed(seen)


def _listed(seen) -> pd.DataFrame:
    n = np.array(list(seen.values()), np.int64).reshape(-1, 2)
    return pd.DataFrame({"word": list(seen), "clean": n[:, 0], "toxic": n[:, 1]})


def _company(terms: list[bytes]):
    """In how many rows each pair of terms stands together."""
    index = {w: k for k, w in enumerate(terms)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        together = np.zeros((len(terms), len(terms)), np.int64)
        for pdf in batches:
            for text in pdf.text:
                at = [index[w] for w in words_of(text) & index.keys()]
                together[np.ix_(at, at)] += 1
        a, b = np.nonzero(together)
        yield pd.DataFrame({"a": a.astype("int32"), "b": b.astype("int32"), "n": together[a, b]})

    return run


def _chi2(a0: Column, a1: Column, n: float, pos: float) -> Column:
    have = a0 + a1
    gap = a1 * n - have * pos
    return F.when((have > 0) & (have < n), gap * gap / (have * (n - have)) * n / (pos * (n - pos) or 1.0)).otherwise(0.0)


def alike_terms(sample: DataFrame, n: float, pos: float) -> tuple[tuple[str, str], ...]:
    """Pairs of frequent, class-neutral words of the sample (text, toxic) that stand in like company, most frequent first."""
    words = sample.mapInPandas(_frequent, "word binary, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("a0"), F.sum("toxic").alias("a1"))
    enough = words.withColumn("have", F.col("a0") + F.col("a1")).where((F.col("have") >= max(4.0, LEAST_SHARE * n)) & (F.length("word") >= 2) & (_chi2(F.col("a0"), F.col("a1"), n, pos) < NEUTRAL_CHI2))
    rows = enough.orderBy(F.desc("have"), "word").limit(TERMS).select("word", "have").collect()
    terms, have = [bytes(r.word) for r in rows], np.array([r.have for r in rows], float)
    if len(terms) < 2:
        return ()
    together = np.zeros((len(terms), len(terms)))
    for r in sample.mapInPandas(_company(terms), "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).collect():  # at most TERMS^2 rows
        together[r.a, r.b] = r.n
    share = together / have[:, None]
    np.fill_diagonal(share, 0)  # a word's company are the others
    length = np.sqrt((share**2).sum(1))
    cosine = share @ share.T / np.maximum(np.outer(length, length), 1e-12)
    pairs, free = [], set(range(len(terms)))
    for k in range(len(terms)):
        if k in free:
            free.discard(k)
            near = [(-cosine[k, j], j) for j in free if cosine[k, j] >= ALIKE and have[k] <= RATIO * have[j]]
            if near:
                j = min(near)[1]
                free.discard(j)
                pairs.append((terms[k].decode("utf-8", "replace"), terms[j].decode("utf-8", "replace")))
    return tuple(pairs)


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows with each feature by class; the table of slots bounds memory and rows."""
    seen = np.zeros((2, SLOTS), np.int32)
    for pdf in batches:
        for text, toxic in zip(pdf.text, pdf.toxic, strict=True):
            seen[int(toxic), list({s for w in words_of(text) for s in slots_of(w)})] += 1
    slot = np.nonzero(seen.sum(0))[0]
    yield pd.DataFrame({"slot": slot.astype("int32"), "clean": seen[0, slot].astype("int64"), "toxic": seen[1, slot].astype("int64")})


def _chosen(chosen: np.ndarray, turn: dict[bytes, bytes]):
    index = {int(s): k for k, s in enumerate(chosen)}
    pick = lambda words: sorted({index[s] for w in words for s in slots_of(w) if s in index})

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            words = [words_of(t) for t in pdf.text]
            other = [swapped(w, turn) for w in words]
            yield pd.DataFrame({"doc_id": pdf.doc_id, "toxic": pdf.toxic, "x": [pick(w) for w in words], "other": [None if o is None else pick(o) for o in other]})

    return features


def fit(rows: pd.DataFrame, n: int) -> tuple[np.ndarray, float]:
    """Weights and intercept. rows: toxic, x (features), other (features after the swap, or None); n features."""
    rows = rows.sort_values("doc_id", kind="stable")
    y = rows.toxic.to_numpy(float)
    col = np.concatenate([np.asarray(x, int) for x in rows.x]) if len(rows) else np.empty(0, int)
    row = np.repeat(np.arange(len(rows)), [len(x) for x in rows.x])
    pairs = [(set(map(int, a)), set(map(int, b))) for a, b in zip(rows.x, rows.other, strict=True) if b is not None]
    d_row = np.array([k for k, (a, b) in enumerate(pairs) for _ in a ^ b], int)
    d_col = np.array([f for a, b in pairs for f in a ^ b], int)
    d_val = np.array([1.0 if f in a else -1.0 for a, b in pairs for f in a ^ b])
    rate = (y.sum() + 0.5) / (len(y) + 1.0)
    theta, m, v = np.append(np.zeros(n), np.log(rate / (1 - rate))), np.zeros(n + 1), np.zeros(n + 1)
    for step in range(1, STEPS + 1):
        w = theta[:n]
        z = np.bincount(row, w[col], len(y)) + theta[n]
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        gap = (p - y) / max(1, len(y))
        g = np.append(np.bincount(col, gap[row], n) + 2 * RIDGE * w, gap.sum())
        if len(pairs):
            change = np.bincount(d_row, d_val * w[d_col], len(pairs))
            g[:n] += COUNTERFACTUAL * 2 * np.bincount(d_col, d_val * change[d_row], n) / len(pairs)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return theta[:n], float(theta[n])


def prepare(docs: DataFrame, labels: DataFrame, learn: Column, identities=IDENTITIES) -> tuple[np.ndarray, pd.DataFrame]:
    """(chosen slots, rows: doc_id, toxic, x, other) of the labelled rows for which learn (over doc_id) holds.

    x: the chosen features of each text; other: those after the swap, null where nothing can be swapped. A label that
    occurs twice counts as toxic if one of them is; null labels, and labels without a text, are left out.
    """
    few = labels.where(learn & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    few = few.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).select(F.col("doc_id").alias("l_id"), (F.col("toxic") > 0).cast("int").alias("toxic"))
    # at most SAMPLE rows of two numbers, so it may be broadcast
    sample = written(docs.select("doc_id", "text").join(F.broadcast(few), F.col("doc_id") == F.col("l_id")).select("doc_id", "text", "toxic"), "toxic-sample")
    size = sample.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("pos")).first()
    counts = sample.mapInPandas(_counts, "slot int, clean long, toxic long").groupBy("slot").agg(F.sum("clean").alias("a0"), F.sum("toxic").alias("a1"))
    n, pos = float(size.n), float(size.pos)
    best = counts.withColumn("chi2", _chi2(F.col("a0"), F.col("a1"), n, pos)).where(F.col("chi2") >= LEAST_CHI2).orderBy(F.desc("chi2"), "slot").limit(CHOSEN)
    turn = turns(identities + alike_terms(sample, n, pos))
    chosen = np.array(sorted({r.slot for r in best.select("slot").collect()} | {s for w in turn for s in slots_of(w)}), int)
    return chosen, sample.mapInPandas(_chosen(chosen, turn), "doc_id long, toxic int, x array<int>, other array<int>").toPandas()


def train(docs: DataFrame, labels: DataFrame, learn: Column, identities=IDENTITIES) -> tuple[dict[int, float], float]:
    """(weight by slot, intercept) from the labelled rows for which learn (over doc_id) holds.

    Repeated rows of docs count each; null or empty texts have no features. No labelled row: all scores are a half.
    """
    chosen, rows = prepare(docs, labels, learn, identities)
    weights, bias = fit(rows, len(chosen))
    return {int(s): float(w) for s, w in zip(chosen, weights, strict=True)}, bias


def _scorer(weights: dict[int, float], bias: float):
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        telling: dict[bytes, tuple[int, ...]] = {}  # the chosen features by word
        dull: set[bytes] = set()
        for texts in batches:
            out = []
            for text in texts:
                found: set[int] = set()
                for w in words_of(text) - dull:
                    got = telling.get(w)
                    if got is None:
                        got = tuple(s for s in slots_of(w) if s in weights)
                        if not got:
                            if len(dull) < CACHE:
                                dull.add(w)
                        elif len(telling) < CACHE:
                            telling[w] = got
                    found.update(got)
                out.append(bias + sum(weights[s] for s in sorted(found)))
            yield pd.Series(1 / (1 + np.exp(-np.clip(np.array(out, float), -40, 40))))
            released()

    return score


def held_out(doc_id: Column, parts: int = 4, part: int = 2) -> Column:
    """crc32 of the id as text, mod parts, is part; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def score(docs: DataFrame, model: tuple[dict[int, float], float], keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score for every row of docs, plus the columns `keep`, text among them or not.

    Null or empty text: the score of a text without features. Repeated rows: each scored. Empty table: empty.
    """
    run = F.pandas_udf(_scorer(*model), "double")  # texts go to Python, and only scores come back
    return docs.select("doc_id", *keep, run(F.col("text")).alias("score"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score, as the query's contract has it."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), ~held_out(F.col("doc_id")))
    x = score(docs, model)
    return x.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
