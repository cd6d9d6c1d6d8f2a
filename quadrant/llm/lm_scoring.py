"""Language-model scoring by logistic context mixing over bits.

A text is coded word by word, its end being one more symbol, and every symbol bit by bit. The first bit says whether the
word is new. A known one is coded along the tree of its hash's bits, down to where it is alone; a new one is spelled byte
by byte up to a closing space. All bits are predicted alike: hashed contexts count the zeros and ones that followed them
in training texts, the contexts' log odds are mixed by weights that a gate chooses, and an adaptive map from (gate, mixed
odds) to what then happened refines the mix, whose mean with the map's value is the bit's probability.

- Known words. Contexts are the tree's node over all training tokens, which is what a word count says, and the node within
  each class of texts (languages). The gate is the class that the text is taken for and how much of it the node has seen.
- New words. Contexts are the last 0 to 4 bytes of the word, and all of it so far, over the distinct training words. The
  gate is how much each long context has seen, and whether the word begins.

Which class a text is taken for follows the text: the classes' shares in it come from the last WINDOW words, and a word's
probability is the mean of its probabilities by class, weighted so. A known word may be spelled too, so that after any
beginning of a text the probabilities of all words and of its end add up to 1. The sum over a text is its total in bits.

- Words before. Ahead of that, up to two bits say whether a word is the one that last came, in the text so far, after the
  same two words before it, and whether it is the one that last came after the same one. Contexts are the two words, the
  one word and the text, each with how often it was right and wrong so far; their log odds are mixed by weights that a gate
  chooses (which bit, how often its context was tried, whether both say the same), and refined as above. A word foretold
  may be coded without these bits' yes too, so chances still add up to 1.

So each distinct word is coded once for each class, however often it occurs, and a text's tokens then take their
prices by their contexts. Counts of word pairs over different texts are not kept. Weights of the bits for words before are
those of the best fit over all tokens of training texts, which is found from how often each of CELLS states came. Everything is learned from all training texts: counts are sums over them;
weights are learned online, by gradient steps in passes over the distinct words, each share of them (by hash, whatever the
partitions) by itself, and averaged. A word's own occurrence is taken off the counts while it trains weights (leave one
out). The spelling model has a fixed size (SLOT_BITS), which bounds what is broadcast; of the tree only its top, of at
most 2^MOST_TOP nodes, is; what is gathered grows with the corpus.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrant.llm.common import released, table, written

#: log2 of the slots by context: 0, 1, 2, 3, 4 bytes, the whole word so far. Four bits in a row lie in 16 slots together.
SLOT_BITS = (10, 17, 20, 20, 21, 22)
CONTEXTS = len(SLOT_BITS)
OFFSETS = np.cumsum([0, *(1 << b for b in SLOT_BITS)]).astype(np.int64)
CHUNK = 1 << 14
GATES, BUCKETS, RATE, PASSES = 54, 33, 0.05, 2
#: Bytes a block of texts has at most (one text is never cut), words coded at once; edges a step of learning; bytes of a word coded one position at a
#: time, and edges that later positions, where few words are left, are joined up to.
BLOCK_BYTES, BATCH, STEP, HEAD, JOINED = 24_000_000, 65_536, 4096, 64, 256
MULTIPLIERS = (np.random.default_rng(11).integers(1, 1 << 62, CONTEXTS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
END = b""  # the end of a text among the words, which are never empty
#: Classes of texts by name at most, besides one for all others; words of evidence the gate looks back at.
CLASSES, WINDOW = 4, 24
KINDS = CLASSES + 1
#: Contexts of a known word's bit: all texts, then each class. Levels of how much of the gate's class a node has seen.
VIEWS, SEEN = KINDS + 1, (1, 3, 10, 100)
TREE_GATES, TREE_RATE, CHUNK_WORDS = KINDS * (len(SEEN) + 1), 0.3, 2048
#: Bytes of text for each share of the words, more or less; buckets of the tree in a share, and the most levels above
#: buckets, as powers of two.
SHARE_BYTES, SHARE_BUCKETS, MOST_TOP = 32_000_000, 4, 20
#: Bits of words before: log odds are rounded to whole numbers up to ODDS_MOST either way, a context's tries are told apart from
#: these on; tokens looked at together (one text is never cut).
ODDS_MOST, TRIED, TOKENS = 6, (1, 2, 4), 1 << 17
ODDS = 2 * ODDS_MOST + 1
BEFORE_GATES = 2 * 2 * (len(TRIED) + 1)
CELLS = BEFORE_GATES * ODDS**3
TIMES = [f"t{k}" for k in range(CLASSES + 1)]
PRICES = [f"p{k}" for k in range(CLASSES + 1)]
BLOCK = "block long, id string, held_out boolean, n_bytes long, idx binary, share long, words binary, times binary"
BLOCK_SCHEMA = pa.schema([("block", pa.int64()), ("id", pa.string()), ("held_out", pa.bool_()), ("n_bytes", pa.int64()), ("idx", pa.binary()), ("share", pa.int64()), ("words", pa.binary()), ("times", pa.binary())])


def hash_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _highest(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)


def _blocks(apart: int):
    """A row a text, with its words' numbers in the block in order; and a row a block and share, with the block's words of
    the share, their numbers and how often they occur in training texts of each class. A block's number is drawn, and is
    fixed when the table is written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            ends, at = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)), 0
            while at < len(batch):
                upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK_BYTES)))
                yield pa.RecordBatch.from_pandas(_block(batch.slice(at, upto - at), texts.slice(at, upto - at), apart), BLOCK_SCHEMA, preserve_index=False)
                at = upto

    return run


def _block(batch: pa.RecordBatch, texts: pa.Array, apart: int) -> pd.DataFrame:
    words = pc.ascii_split_whitespace(pc.ascii_lower(texts)).cast(pa.list_(pa.binary()))  # ASCII only, both
    coded = words.flatten().dictionary_encode()
    code, bounds = coded.indices.to_numpy().astype("<i4"), words.offsets.to_numpy()
    # white space at either end of a text leaves an empty piece, which is no word
    listed = coded.dictionary.to_pylist()
    empty = listed.index(b"") if b"" in listed else -1
    listed = [w for w in listed if w]
    if empty >= 0:
        real = code != empty
        code, bounds = code[real], np.concatenate([[0], np.cumsum(real)])[bounds]
        code -= code > empty
    end, n = len(listed), np.diff(bounds)
    held, kind = batch.column("held_out").to_numpy(zero_copy_only=False), batch.column("kind").to_numpy()
    trained, of = np.zeros((end + 1, KINDS), "<i8"), np.repeat(np.where(held, KINDS, kind), n)
    for k in range(KINDS):
        trained[:end, k] = np.bincount(code[of == k], minlength=end)
        trained[end, k] = ((kind == k) & ~held).sum()
    name = uuid.uuid4().int >> 65
    idx = [zlib.compress(np.append(code[a:b], np.int32(end)).tobytes(), 1) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    of_texts = pd.DataFrame({"block": name, "id": batch.column("id").to_pylist(), "held_out": held, "n_bytes": pc.binary_length(texts).to_numpy(zero_copy_only=False), "idx": idx})
    listed.append(END)
    share, out = _highest(hash_of(listed), apart), []
    for k in np.unique(share):
        at = np.nonzero(share == k)[0]
        out.append({"block": name, "share": k, "idx": zlib.compress(at.astype("<i4").tobytes(), 1), "words": zlib.compress(b" ".join([listed[i] for i in at]), 1), "times": zlib.compress(trained[at].tobytes(), 1)})
    return pd.concat([of_texts, pd.DataFrame(out)]).reindex(columns=BLOCK_SCHEMA.names).astype({"share": "Int64", "n_bytes": "Int64"})


class Coder:
    """The bits of a batch of words, each edge of the tree of their beginnings once.

    Contexts are functions of a word's beginning, so words that begin alike share their first bits' costs. Beyond HEAD
    bytes nothing is shared, and positions come several at once where few words are that long; contexts are of the whole
    word there too.
    """

    def __init__(self, words: list[bytes]):
        coded = [w + b" " if w else b"\0" for w in words]
        distinct = sorted(set(coded))
        place = {w: k for k, w in enumerate(distinct)}
        self.inverse = np.fromiter(map(place.__getitem__, coded), np.int64, len(coded))
        self.times = np.bincount(self.inverse, minlength=len(distinct)).astype(np.float64)
        self.size = np.fromiter(map(len, distinct), np.int64, len(distinct))
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(distinct), np.uint8)
        self.total = np.zeros(len(distinct))

    def edges(self):
        """(position, rows, weight, byte, contexts): for each of the first HEAD positions the rows that don't share it with
        the row before, then later positions of all rows, the first of several at once."""
        live, group, i = np.arange(len(self.size)), np.zeros(len(self.size), np.int64), 0
        prefix = np.full(len(live), GOLDEN)
        with np.errstate(over="ignore"):
            while True:
                on = self.size[live] > i
                live, group, prefix = live[on], group[on], prefix[on]
                if not len(live):
                    return
                count = 1 if i < HEAD else min(max(1, JOINED // len(live)), int(self.size[live].min()) - i)
                at = self.start[live] + i + np.arange(count)[:, None]
                every = self.flat[at].astype(np.uint64)
                whole = np.empty(every.shape, np.uint64)
                for k in range(count):
                    whole[k] = prefix
                    prefix = (prefix ^ (every[k] + np.uint64(1))) * GOLDEN
                    prefix ^= prefix >> np.uint64(27)
                if i < HEAD:
                    new = np.ones(len(live), bool)
                    new[1:] = (group[1:] != group[:-1]) | (every[0, 1:] != every[0, :-1])
                    first = np.nonzero(new)[0]
                    group = np.cumsum(new) - 1
                    weight = np.add.reduceat(self.times[live], first)
                    at, every, whole, rows = at[:, first], every[:, first], whole[:, first], live[first]
                else:
                    weight, rows = np.tile(self.times[live], count), np.tile(live, count)
                last, contexts = np.zeros(at.shape, np.uint64), [np.zeros(len(rows), np.uint64)]
                for o in range(1, 5):
                    if i >= o:
                        last = last | (self.flat[at - o].astype(np.uint64) << np.uint64(8 * (o - 1)))
                    contexts.append(last.ravel())
                yield i, rows, weight, every.ravel(), [(c + np.uint64(o)) * GOLDEN for o, c in enumerate([*contexts, whole.ravel()])]
                i += count

    def bits(self):
        """(position, rows, weight, slots[CONTEXTS, rows], c0, bit) for each bit of each edge."""
        for i, rows, weight, byte, contexts in self.edges():
            c0, line = np.ones(len(rows), np.uint64), np.empty((CONTEXTS, len(rows)), np.int64)
            for j in range(7, -1, -1):
                if j in (7, 3):  # the half byte's slots, by its context and the half before
                    inner = np.ones(len(rows), np.int64)
                    with np.errstate(over="ignore"):
                        for o, c in enumerate(contexts):
                            h = (c ^ c0) * MULTIPLIERS[o]
                            h ^= h >> np.uint64(29)
                            line[o] = (((h * GOLDEN) >> np.uint64(68 - SLOT_BITS[o])).astype(np.int64) << 4) + OFFSETS[o]
                bit = (byte >> np.uint64(j)) & np.uint64(1)
                yield i, rows, weight, line + inner, c0, bit.astype(bool)
                c0 = (c0 << np.uint64(1)) | bit
                inner = (inner << 1) | bit.astype(np.int64)

    def add(self, i: int, rows: np.ndarray, cost: np.ndarray) -> None:
        """Adds the costs of the edges that edges() gives for a position to those of all words that hold them."""
        if i < HEAD:
            live = np.nonzero(self.size > i)[0]
            self.total[live] += cost[np.searchsorted(rows, live, "right") - 1]
        else:
            np.add.at(self.total, rows, cost)


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    """All blocks' words of a share, by word, as one row, with where each block's are among them."""
    number: dict[bytes, int] = {}
    own, sizes, times = [], [], np.zeros((1024, KINDS), "<i8")
    for listed, each in zip(pdf.words, pdf.times, strict=True):  # one block's words at a time
        part = zlib.decompress(listed).split(b" ")
        mine = np.fromiter((number.setdefault(w, len(number)) for w in part), np.int32, len(part))
        if len(number) > len(times):
            times = np.concatenate([times, np.zeros((len(number), KINDS), "<i8")])
        times[mine] += np.frombuffer(zlib.decompress(each), "<i8").reshape(-1, KINDS)  # a block lists a word once
        own.append(mine)
        sizes.append(len(part))
    words = sorted(number)
    order = np.fromiter(map(number.__getitem__, words), np.int32, len(words))
    number.clear()
    back = np.empty(len(words), "<i4")
    back[order] = np.arange(len(words))
    own, times = back[np.concatenate(own)], times[order]
    released()
    squeeze = lambda x: zlib.compress(x.tobytes(), 1)
    return pd.DataFrame({"share": [int(pdf.share.iat[0])], "words": [zlib.compress(b" ".join(words), 1)], "times": [squeeze(times)], "blocks": [pdf.block.tolist()], "sizes": [sizes], "own": [squeeze(own)], "idx": [zlib.compress(b"".join(map(zlib.decompress, pdf.idx)), 1)]})


class Share:
    """A share's words in order, their hashes and times."""

    def __init__(self, row):
        self.words = zlib.decompress(row.words).split(b" ")
        self.hashes = hash_of(self.words)
        self.times = np.frombuffer(zlib.decompress(row.times), "<i8").reshape(-1, KINDS)
        self.count = self.times.sum(1)
        self.trained = [w for w, c in zip(self.words, self.count, strict=True) if c]

    def trees(self, bits: int, top: np.ndarray):
        """(places of a bucket's known words, their tree) for each bucket."""
        bucket = _highest(self.hashes, bits)
        for b in np.unique(bucket[self.count > 0]):
            at = np.nonzero((bucket == b) & (self.count > 0))[0]
            yield at, Tree(self.hashes[at], self.times[at].astype(np.float64), int(b), top)


def _shares(batches: Iterator[pd.DataFrame]) -> Iterator[Share]:
    for pdf in batches:
        for row in pdf.itertuples(index=False):
            yield Share(row)


def _batches(words: list[bytes]) -> Iterator[list[bytes]]:
    for a in range(0, len(words), BATCH):
        yield words[a : a + BATCH]


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Zeros and ones by slot, over some shares, in compressed chunks; the table's size bounds memory."""
    seen, some = np.zeros(2 * OFFSETS[-1], np.float32), False
    for share in _shares(batches):
        for words in _batches(share.trained):
            some = True
            for _, _, weight, slots, _, bit in Coder(words).bits():
                weight = weight.astype(np.float32)
                for line in slots:  # in place: a sum over all slots for some words would need several times the table's memory
                    np.add.at(seen, 2 * line + bit, weight)
    for a in range(0, len(seen) if some else 0, CHUNK):
        part = seen[a : a + CHUNK]
        if part.any():
            yield pd.DataFrame({"chunk": [a // CHUNK], "counts": [zlib.compress(part.astype("<f4").tobytes(), 1)]})


def _add_up(pdf: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(zlib.decompress(b), "<f4").astype(np.float64) for b in pdf.counts)
    return pd.DataFrame({"chunk": [pdf.chunk.iat[0]], "counts": [zlib.compress(total.astype("<f4").tobytes(), 1)]})


def _odds(seen, slots, own_bit=None):
    """Log odds and amount seen by context; own_bit: one such occurrence is left out."""
    pair = seen[slots]
    zeros, ones = pair[..., 0], pair[..., 1]
    if own_bit is not None:
        zeros, ones = np.maximum(zeros - ~own_bit, 0), np.maximum(ones - own_bit, 0)
    return np.log((ones + np.float32(0.4)) / (zeros + np.float32(0.4))), zeros + ones


def _gate(amount, first: bool):
    level = (amount[3:] > 0).astype(np.int64) + (amount[3:] > 2.5)
    return (level[0] * 9 + level[1] * 3 + level[2]) * 2 + int(first)


def _squash(z):
    return 1 / (1 + np.exp(-z))


def _bucket(z):
    return np.clip(np.rint(z * 2 + BUCKETS // 2), 0, BUCKETS - 1).astype(np.int64)


def _learn(model, bits: int, top: np.ndarray):
    """Weights of both mixes learned online over each share, then the refining maps' sums under those weights."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for share in _shares(batches):
            steps = [step for words in _batches(share.trained) for step in _spelling_steps(model.value, words)]
            spelling = _online(steps, np.full((GATES, CONTEXTS), 0.3, np.float32), RATE, 256)
            del steps  # else both lists are held at once
            steps = [step for _, tree in share.trees(bits, top) for step in _tree_steps(tree)]
            known = _online(steps, _tree_first(), TREE_RATE, TREE_GATES)
            del steps
            out = pd.concat([spelling.assign(mix=np.int8(0)), known.assign(mix=np.int8(1))])
            yield out.astype({"mix": "int32"})

    return run


def _online(steps, weights: np.ndarray, rate: float, cells: int) -> pd.DataFrame:
    """PASSES of gradient steps. A step: (odds by context, gate, cell of the map, bit, weight)."""
    gates, heard, refine = len(weights), np.zeros(len(weights)), np.zeros((2, cells * BUCKETS))
    weights = weights.copy()
    for turn in range(PASSES + 1):
        for odds, gate, cell, bit, weight in steps:
            odds = odds.astype(np.float32)
            z = np.einsum("ok,ko->k", odds, weights[gate])
            if turn == PASSES:
                at = cell.astype(np.int64) * BUCKETS + _bucket(z)
                refine[0] += np.bincount(at, weight, refine.shape[1])
                refine[1] += np.bincount(at, weight * bit, refine.shape[1])
                continue
            share = np.bincount(gate, weight, gates)
            err = (bit - _squash(z)) * weight
            for o in range(len(odds)):
                weights[:, o] += (rate * np.bincount(gate, err * odds[o], gates) / np.maximum(share, 1e-9)).astype(np.float32)
            heard += share
    return _sums(weights, heard, refine)


def _totals(bits: int):
    """Tokens, and words seen once, by bucket and class, and how many words are known."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for share in _shares(batches):
            bucket = _highest(share.hashes, bits)
            for b in np.unique(bucket):
                times, count = share.times[bucket == b].astype(float), share.count[bucket == b]
                yield pd.DataFrame({"bucket": [int(b)], "times": [times.sum(0)], "once": [times[count == 1].sum(0)], "known": [int((count > 0).sum())]}).astype({"bucket": "int32"})

    return run


def _spelling_steps(seen, words: list[bytes]):
    for i, _, weight, slots, c0, bit in Coder(words).bits():
        odds, amount = _odds(seen, slots, bit)
        step = odds.astype(np.float16), _gate(amount, i == 0).astype(np.int8), c0.astype(np.uint8), bit, weight.astype(np.float32)
        for a in range(0, len(bit), STEP):
            yield step[0][:, a : a + STEP], *(x[a : a + STEP] for x in step[1:])


def _sums(weights, heard, refine) -> pd.DataFrame:
    value = np.concatenate([(weights * heard[:, None]).ravel(), heard, refine.ravel()])
    return pd.DataFrame({"place": np.arange(len(value), dtype=np.int32), "value": value})


def _averaged(found: pd.DataFrame, gates: int, contexts: int, cells: int, first: np.ndarray):
    """(weights, refining map) from the sums of all shares. first: weights of gates that nothing was heard of."""
    value = np.zeros(gates * contexts + gates + 2 * cells * BUCKETS)
    value[found.place] = found.value
    weights, heard, refine = np.split(value, [gates * contexts, gates * contexts + gates])
    weights = np.where(heard[:, None] > 0, weights.reshape(gates, contexts) / np.maximum(heard, 1e-9)[:, None], first).astype(np.float32)
    times, ones = refine.reshape(2, -1)
    plain = np.tile(_squash((np.arange(BUCKETS) - BUCKETS // 2) / 2), cells)
    return weights, (ones + 8 * plain) / (times + 8)


def spelling_costs(seen, mixer, words: list[bytes]) -> np.ndarray:
    """log10 of each word's probability when spelled."""
    weights, refined = mixer
    out = [np.empty(0)]
    for part in _batches(words):
        coder, edge = Coder(part), 0.0
        for i, rows, _, slots, c0, bit in coder.bits():
            odds, amount = _odds(seen, slots)
            z = np.einsum("ok,ko->k", odds, weights[_gate(amount, i == 0)])
            p = (_squash(z) + refined[c0.astype(np.int64) * BUCKETS + _bucket(z)]) / 2
            p = np.clip(p, 1e-5, 1 - 1e-5)
            edge = edge + np.log10(np.where(bit, p, 1 - p))
            if c0[0] >> np.uint64(7):  # the byte's last bit
                coder.add(i, rows, edge)
                edge = 0.0
        out.append(coder.total[coder.inverse])
    return np.concatenate(out)


def fit(shares: DataFrame, tasks: int, bits: int, top: np.ndarray):
    """(model, spelling's mixer, tree's mixer): the slots' counts, broadcast, and two pairs of (weights, refining map)."""
    sc = shares.sparkSession.sparkContext
    # each task sends a table of fixed size, so a quarter as many tasks as shares
    counted = shares.coalesce(max(1, tasks // 4)).mapInPandas(_count, "chunk int, counts binary").groupBy("chunk").applyInPandas(_add_up, "chunk int, counts binary")
    flat = np.zeros(2 * OFFSETS[-1], np.float32)
    for row in counted.toLocalIterator():  # of fixed size in all, see SLOT_BITS
        part = np.frombuffer(zlib.decompress(row.counts), "<f4")
        flat[row.chunk * CHUNK : row.chunk * CHUNK + len(part)] = part
    seen = flat.reshape(-1, 2)
    model = sc.broadcast(seen)
    learned = shares.mapInPandas(_learn(model, bits, top), "place int, value double, mix int").groupBy("mix", "place").agg(F.sum("value").alias("value")).toPandas()  # of fixed size
    spelling = _averaged(learned[learned.mix == 0], GATES, CONTEXTS, 256, np.full((GATES, CONTEXTS), 0.3))
    return model, spelling, _averaged(learned[learned.mix == 1], TREE_GATES, VIEWS, TREE_GATES, _tree_first())


class Tree:
    """The nodes of the tree of hashes above one bucket's words and within it. top: tokens by bucket and class."""

    def __init__(self, hashes: np.ndarray, times: np.ndarray, bucket: int, top: np.ndarray):
        self.order = np.argsort(hashes, kind="stable")
        self.hashes, self.times = hashes[self.order], times[self.order]
        self.bits, self.bucket = int(len(top) - 1).bit_length(), bucket
        self.above = np.concatenate([np.zeros((1, KINDS)), np.cumsum(top, 0)])

    def nodes(self):
        """(rows, zeros, ones, bit) by level: the words under a node that parts, and its tokens by view (VIEWS, rows).

        Where all of a node's words go one way, there is no bit to code. Above the bucket all words share their nodes: rows
        is None there, for all of them, and there is one column.
        """
        for level in range(self.bits):
            half = 1 << (self.bits - level - 1)
            lo = self.bucket // (2 * half) * 2 * half
            zeros, ones = self.above[lo + half] - self.above[lo], self.above[lo + 2 * half] - self.above[lo + half]
            if zeros.sum() and ones.sum():
                yield None, _views(zeros[:, None]), _views(ones[:, None]), np.full(1, bool(self.bucket & half))
        live, group = np.arange(len(self.hashes)), np.zeros(len(self.hashes), np.int64)
        for level in range(self.bits, 64):
            if not len(live):
                return
            bit = ((self.hashes[live] >> np.uint64(63 - level)) & np.uint64(1)).astype(bool)
            first = np.nonzero(np.r_[True, group[1:] != group[:-1]])[0]
            number = np.cumsum(np.r_[True, group[1:] != group[:-1]]) - 1
            times = self.times[live]
            both = np.add.reduceat(times, first, 0)
            ones = np.add.reduceat(np.where(bit[:, None], times, 0), first, 0)
            parts = (ones.sum(1) > 0) & (ones.sum(1) < both.sum(1))
            on = parts[number]
            if on.any():
                yield live[on], _views((both - ones)[number[on]].T), _views(ones[number[on]].T), bit[on]
            group = number * 2 + bit
            size = np.bincount(group)
            keep = size[group] > 1
            live, group = live[keep], group[keep]


def _views(by_class: np.ndarray) -> np.ndarray:
    """(VIEWS, rows) from (classes, rows): all of them first."""
    return np.concatenate([by_class.sum(0, keepdims=True), by_class])


def _tree_first() -> np.ndarray:
    """Weights to start from: most on the odds of the gate's class, the rest on those of all texts."""
    first = np.zeros((KINDS, len(SEEN) + 1, VIEWS), np.float32)
    first[:, :, 0] = 0.3
    for g in range(KINDS):
        first[g, :, g + 1] = 0.7
    return first.reshape(TREE_GATES, VIEWS)


def _tree_odds(zeros, ones, g: int):
    """(odds by view, gate) of nodes' bits for a text of class g."""
    gate = g * (len(SEEN) + 1) + np.searchsorted(SEEN, zeros[g + 1] + ones[g + 1], "right")
    return np.log((ones + 0.4) / (zeros + 0.4)), gate


def _tree_steps(tree: Tree):
    """A bucket's words, each as often as texts of each class hold it and without the occurrence at hand."""
    again = tree.times.sum(1) > 1  # a word seen once would be new without its own occurrence
    for rows, zeros, ones, bit in tree.nodes():
        for g in range(KINDS):
            times = tree.times[:, g] * again
            weight = np.array([times.sum()]) if rows is None else times[rows]
            at = np.nonzero(weight > 0)[0]
            for a in range(0, len(at), CHUNK_WORDS):
                on = at[a : a + CHUNK_WORDS]
                z0, z1, own = zeros[:, on], ones[:, on], bit[on]
                for view in (0, g + 1):
                    z0[view] -= ~own
                    z1[view] -= own
                odds, gate = _tree_odds(z0, z1, g)
                yield odds.astype(np.float32), gate, gate, own, weight[on]


def tree_costs(tree: Tree, mixer) -> np.ndarray:
    """log10 of each word's probability among the known ones, by word (in the tree's order of rows given) and class."""
    weights, refined = mixer
    out = np.zeros((len(tree.hashes), KINDS))
    for rows, zeros, ones, bit in tree.nodes():
        for g in range(KINDS):
            odds, gate = _tree_odds(zeros, ones, g)
            z = np.einsum("ok,ko->k", odds, weights[gate])
            p = np.clip((_squash(z) + refined[gate * BUCKETS + _bucket(z)]) / 2, 1e-7, 1 - 1e-7)
            out[slice(None) if rows is None else rows, g] += np.log10(np.where(bit, p, 1 - p))
    back = np.empty_like(out)
    back[tree.order] = out
    return back


def priced(share: Share, spelled: np.ndarray, bits: int, top: np.ndarray, mixer, new: np.ndarray) -> np.ndarray:
    """log10 of each word's probability by class. spelled: log10 of that of its spelling; new: chance of a new word by class."""
    price = np.log10(new) + spelled[:, None]
    for at, tree in share.trees(bits, top):
        by_tree = np.log10(1 - new) + tree_costs(tree, mixer)
        price[at] = np.logaddexp(price[at] * np.log(10), by_tree * np.log(10)) / np.log(10)
    return price


def _price(model, spelling, bits: int, top: np.ndarray, mixer, new: np.ndarray):
    """For each block of each share, its words' numbers, counts and prices as arrays."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                share = Share(row)
                price = priced(share, spelling_costs(model.value, spelling, share.words), bits, top, mixer, new).astype("<f4")
                own, idx, at = np.frombuffer(zlib.decompress(row.own), "<i4"), np.frombuffer(zlib.decompress(row.idx), "<i4"), 0
                for block, n in zip(row.blocks, row.sizes, strict=True):
                    mine = own[at : at + n]
                    yield pd.DataFrame({"block": [block], "idx": [zlib.compress(idx[at : at + n].tobytes(), 1)], "counts": [zlib.compress(share.count[mine].astype("<i8").tobytes(), 1)], "prices": [price[mine].tobytes()]})
                    at += n

    return run


def held_out(doc_id: Column, parts: int = 5, part: int = 1) -> Column:
    """crc32 of the id as text, mod parts, is part; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def mixed(price: np.ndarray, shares: np.ndarray, sizes: list[int] | None = None) -> np.ndarray:
    """log10 of the probability of each word of some texts. price: by word and class; shares: of tokens, by class; sizes: of
    the texts, one after another; one text if not given.

    The classes' weights before a word are their shares times what the last WINDOW words say for each.
    """
    sizes = [len(price)] if sizes is None else sizes
    ends = np.cumsum(sizes, dtype=np.int64)
    p = np.ascontiguousarray(price.T) * np.log(10)
    so_far = np.zeros(p.shape)
    for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True):  # by text, so that copies score the same to the last digit
        np.cumsum(p[:, a : b - 1], 1, out=so_far[:, a + 1 : b])
    back = np.maximum(np.arange(p.shape[1]) - WINDOW, np.repeat(ends - sizes, sizes))
    lead = np.log(shares)[:, None] + so_far - so_far[:, back]
    gate = np.exp(np.maximum(lead - lead.max(0), -690))
    gate = 0.99 * gate / gate.sum(0) + 0.01 * shares[:, None]
    best = p.max(0)
    return (best + np.log((gate * np.exp(p - best)).sum(0))) / np.log(10)


def _follows(key: np.ndarray, tokens: np.ndarray):
    """By token: a number of its context (key); the token that came last in the same context, -1 for none; how often such
    was tried in this context before, and was right; and whether it is right now."""
    bits = len(key).bit_length()
    if int(key.max(initial=0)) >> (62 - bits):
        order = np.argsort(key, kind="stable")
        ordered = key[order]
    else:  # the same order, sorted with places
        ordered = np.sort((key << bits) | np.arange(len(key)))
        order, ordered = ordered & ((1 << bits) - 1), ordered >> bits
    token = tokens[order]
    first = np.r_[True, ordered[1:] != ordered[:-1]]
    group, start = np.cumsum(first) - 1, np.flatnonzero(first)
    last = np.where(first, -1, np.r_[-1, token[:-1]])
    hit = last == token
    right = np.cumsum(hit) - hit
    right -= right[start][group]
    tried = np.maximum(np.arange(len(key)) - start[group] - 1, 0)
    out = [np.empty(len(key), x.dtype) for x in (group, last, tried, right, hit)]
    for x, y in zip(out, (group, last, tried, right, hit), strict=True):
        x[order] = y
    return out


def _rounded(right: np.ndarray, tried: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(np.log((right + 0.4) / (tried - right + 0.4))), -ODDS_MOST, ODDS_MOST).astype(np.int64) + ODDS_MOST


def words_before(tokens: np.ndarray, sizes: list[int]):
    """The bits of words before, of some texts' tokens: (whether it is coded, its cell, whether it is a yes) by token, for the
    two words before, then for the one. The second is not coded where it would ask for the same word again; after a yes of
    the first it isn't needed."""
    start = np.cumsum([0, *sizes[:-1]])
    text, width = np.repeat(np.arange(len(sizes)), sizes), int(tokens.max(initial=0)) + 2
    before = np.r_[-1, tokens[:-1]].astype(np.int64)
    before[start] = width - 1
    one, *after_one = _follows(text * width + before, tokens)
    earlier = np.r_[0, one[:-1]]  # the two words are the one before and the context that it came in
    earlier[start] = one[start]
    _, *after_two = _follows(earlier * width + before, tokens)

    def in_text(x: np.ndarray) -> np.ndarray:
        so_far = np.cumsum(x) - x
        return so_far - so_far[start][text]

    def bit(own, other, coded, flag, kind):
        last, tried, right, hit = own
        shown = np.where(flag if kind == 0 else other[0] >= 0, _rounded(other[2], other[1]), ODDS_MOST)
        gate = (kind * 2 + flag) * (len(TRIED) + 1) + np.searchsorted(TRIED, tried, "right")
        cell = ((gate * ODDS + _rounded(right, tried)) * ODDS + shown) * ODDS + _rounded(in_text(hit), in_text(last >= 0))
        return coded, cell, hit

    same = after_one[0] == after_two[0]
    two_known = after_two[0] >= 0
    return bit(after_two, after_one, two_known, same, 0), bit(after_one, after_two, (after_one[0] >= 0) & ~same, two_known, 1)


def _together(idx) -> Iterator[list[np.ndarray]]:
    """Texts' words' numbers, of some texts at a time."""
    some, n = [], 0
    for x in idx:
        i = np.frombuffer(zlib.decompress(x), "<i4")
        if some and n + len(i) > TOKENS:
            yield some
            some, n = [], 0
        some.append(i)
        n += len(i)
    if some:
        yield some


def _count_before(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How often each cell's bit was coded, and was a yes, in some texts."""
    times = np.zeros((2, CELLS), np.int64)
    for pdf in batches:
        for texts in _together(pdf.idx):
            two, one = words_before(np.concatenate(texts), list(map(len, texts)))
            for (coded, cell, hit), on in ((two, two[0]), (one, one[0] & ~(two[0] & two[2]))):
                times[0] += np.bincount(cell[on], minlength=CELLS)
                times[1] += np.bincount(cell[on & hit], minlength=CELLS)
    at = np.flatnonzero(times[0])
    yield pd.DataFrame({"cell": at.astype(np.int32), "n": times[0, at], "yes": times[1, at]})


def _fit_before(cell: np.ndarray, n: np.ndarray, yes: np.ndarray) -> np.ndarray:
    """The chance of a yes by cell: the contexts' odds mixed by each gate's best weights (Newton steps), and refined."""
    times, ones = np.zeros(CELLS), np.zeros(CELLS)
    times[cell], ones[cell] = n, yes
    gate, own, other, text = np.unravel_index(np.arange(CELLS), (BEFORE_GATES, ODDS, ODDS, ODDS))
    x = np.stack([own - ODDS_MOST, other - ODDS_MOST, text - ODDS_MOST, np.ones(CELLS)], 1).astype(float)
    first, chance = np.array([0.7, 0.2, 0.1, -1.0]), np.empty(CELLS)
    plain = _squash((np.arange(BUCKETS) - BUCKETS // 2) / 2)
    for g in range(BEFORE_GATES):
        on = gate == g
        a, t, o, w = x[on], times[on], ones[on], first.copy()
        for _ in range(30):
            p = _squash(a @ w)
            step = np.linalg.solve((a.T * (t * p * (1 - p))) @ a + np.eye(4), a.T @ (t * p - o) + w - first)
            w -= step * min(1.0, 1 / max(np.abs(step).max(), 1e-12))
        z = a @ w
        at = _bucket(z)
        refined = (np.bincount(at, o, BUCKETS) + 8 * plain) / (np.bincount(at, t, BUCKETS) + 8)
        chance[on] = np.clip((_squash(z) + refined[at]) / 2, 1e-5, 1 - 1e-5)
    return chance


def with_words_before(price: np.ndarray, tokens: np.ndarray, sizes: list[int], chance: np.ndarray) -> np.ndarray:
    """log10 of the probability of each token of some texts. price: that without the bits of words before."""
    for coded, cell, hit in reversed(words_before(tokens, sizes)):
        without = price + np.log10(1 - chance[cell])
        foretold = np.logaddexp(without * np.log(10), np.log(chance[cell])) / np.log(10)
        price = np.where(coded, np.where(hit, foretold, without), price)
    return price


def _sum_up(tokens: int, distinct: int, shares: np.ndarray, chance: np.ndarray):
    def run(texts: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        idx, c, price = (np.concatenate([np.frombuffer(x, t) for x in parts]) for parts, t in ((map(zlib.decompress, words.idx), "<i4"), (map(zlib.decompress, words.counts), "<i8"), (words.prices, "<f4")))
        place = np.argsort(idx)
        price, c = price.reshape(-1, KINDS)[place].astype(np.float64), c[place]
        base, out = np.log10((c + 0.5) / (tokens + 0.5 * (distinct + 1))), []
        for some in _together(texts.idx):
            sizes = list(map(len, some))
            every = np.concatenate(some)
            each = with_words_before(mixed(price[every], shares, sizes), every, sizes, chance)
            totals = np.add.reduceat(each, np.cumsum([0, *sizes[:-1]]))
            out += [(len(i), int((c[i] > 0).sum()), float(base[i].sum()), float(x)) for i, x in zip(some, totals, strict=True)]
        frame = pd.DataFrame(out, columns=["n_tokens", "n_known", "base_score", "score"])
        return pd.concat([texts[["id", "held_out", "n_bytes"]].reset_index(drop=True), frame], axis=1).assign(train_tokens=tokens)

    return run


def score(docs: DataFrame, held: Column, kind: str | None = "lang") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits, bits_per_byte for every row of docs.

    held: which rows not to learn from. kind: the column with the texts' classes, its CLASSES most frequent values; of
    the rows scored it is not used. bits: the text's total; bits_per_byte: over its UTF-8 bytes, one at least. Null or
    empty text: the end only. Null doc_id: as held says. Null class: that of all rarer ones. Repeated rows: each scored,
    and each counted if trained on. Nothing to learn from: all words are new, and the model guesses. Empty table: empty.
    """
    named = [] if kind is None else [r[0] for r in docs.where(F.col(kind).isNotNull() & ~held).groupBy(kind).count().orderBy(F.desc("count"), kind).limit(CLASSES).collect()]
    number = F.lit(CLASSES)
    for k, value in enumerate(named):
        number = F.when(F.col(kind) == F.lit(value), k).otherwise(number)
    x = docs.select(F.col("doc_id").cast("string").alias("id"), "text", held.alias("held_out"), number.cast("int").alias("kind"))
    size = x.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    apart = min(MOST_TOP - SHARE_BUCKETS, max(0, (size // SHARE_BYTES).bit_length()))
    bits = apart + SHARE_BUCKETS
    blocks = written(x.mapInArrow(_blocks(apart), BLOCK), "lm-blocks")
    listed = blocks.where("share IS NOT NULL").select("share", "block", "words", "times", "idx")
    shares = written(listed.groupBy("share").applyInPandas(_merge, "share long, words binary, times binary, blocks array<long>, sizes array<long>, own binary, idx binary"), "lm-shares")
    single, top = np.zeros(KINDS), np.zeros((1 << bits, KINDS))
    distinct = 0
    for row in shares.select("words", "times").mapInPandas(_totals(bits), "bucket int, times array<double>, once array<double>, known long").toLocalIterator():  # at most 2^MOST_TOP rows
        top[row.bucket], distinct = row.times, distinct + row.known
        single += row.once
    total = top.sum(0)
    tokens, of_class = int(total.sum()), (total + 1) / (total.sum() + KINDS)
    rate = (single.sum() + 1) / (tokens + 2)
    new = np.clip((single + 100 * rate) / (total + 100), 1e-4, 0.5)
    spread = lambda *names: shares.select("share", *names).repartition(1 << apart, "share")  # noqa: E731  # a share is a task's work
    model, spelling, mixer = fit(spread("words", "times"), 1 << apart, bits, top)
    costs = spread("words", "times", "blocks", "sizes", "own", "idx").mapInPandas(_price(model, spelling, bits, top, mixer, new), "block long, idx binary, counts binary, prices binary")
    texts = blocks.where("share IS NULL").select("block", "id", "held_out", "n_bytes", "idx")
    cells = texts.where("NOT held_out").select("idx").mapInPandas(_count_before, "cell int, n long, yes long")
    seen = cells.groupBy("cell").agg(F.sum("n").alias("n"), F.sum("yes").alias("yes")).toPandas()  # CELLS rows at most
    chance = _fit_before(*(seen[c].to_numpy() for c in ("cell", "n", "yes")))
    out = texts.groupBy("block").cogroup(costs.groupBy("block")).applyInPandas(_sum_up(tokens, distinct, of_class, chance), "id string, held_out boolean, n_bytes long, n_tokens long, n_known long, base_score double, score double, train_tokens long")
    total_bits = -F.col("score") * float(np.log2(10))
    return out.select(F.col("id").cast("long").alias("doc_id"), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", total_bits.alias("bits"), (total_bits / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored, as the query's contract has it."""
    return score(table(spark, sf_dir, "documents"), held_out(F.col("doc_id")))
