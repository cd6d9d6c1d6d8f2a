"""Best-fit packing by a grouping genetic algorithm on islands.

Documents become pieces of at most CAPACITY tokens; only a longer document is cut. Pieces that fill a sequence are done.
The others are dealt over cells of about CELL pieces, and every cell is packed by DEMES islands, each a Spark row of its
own with a population of packings that starts from best-fit decreasing and blurred copies of it. Crossover injects whole
well-filled bins of one parent into the other, removes the bins that hold a duplicate, and puts the displaced pieces
back by best fit, the largest first. Fewer bins are fitter; of equally many, those with the larger sum of squared fills,
so that full bins get fuller and the rest gathers in few. An epoch, a Spark stage, has GENERATIONS crossovers, and then goes on
until STALE in a row make nothing fitter, or the pieces are in the least number of bins that hold their sum and all of them but
one are filled well, which no crossover can better. After each epoch every island's elite migrates to the next island of its cell. The fittest packing of a cell counts: bins that it fills well are settled, and so are the
fuller ones of the others until at most HANDED_ON of the cell's pieces are left, those of its emptiest bins. What all cells
have left is dealt over as many cells as it takes at CELL pieces each, neighbours joining, and so on until one cell is
left, which settles everything. So each level has at most that share of the pieces of the one before, also where no bin can
be filled well, no cell grows with the corpus, and what isn't full in the end is a few bins, not one a cell.
"""

from __future__ import annotations

import bisect
import random
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrant.llm.bpe import Merges, plain
from quadrant.llm.common import released, table, written

CAPACITY, END_ID = 4096, 1
CELL, SETTLED, HANDED_ON = 2048, 0.995, 0.5
DEMES, DEME_SIZE, EPOCHS, GENERATIONS = 2, 4, 2, 32
STALE = 64  # crossovers in a row without a fitter packing after which an epoch ends
#: crossovers: the GENERATIONS that every epoch has; further: those beyond, until nothing is gained
DEME = "island long, deme int, size binary, population array<binary>, bins int, fill double, crossovers long, further long"
LETTERS = 3_000_000  # bytes of texts whose words are encoded at once
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
_tokenizers: dict = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Words:
    """Ids of whole texts by a tokenizer that never joins words: each distinct word is encoded once for LETTERS bytes."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = Merges.of(self.tokenizer)

    def _library(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after another, and how many each has."""
        found = [e.ids for a in range(0, len(words), 4096) for e in self.tokenizer.encode_batch_fast(words[a : a + 4096], add_special_tokens=False)]
        return np.array([i for ids in found for i in ids], np.uint32), np.fromiter(map(len, found), np.int64, len(found))

    def _symbols(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, sizes, symbols): a word's ids are those of its two symbols, letters and marks; symbol 0 has none."""
        if self.merges:
            easy, letters, marks = plain(words)
        else:
            easy, letters, marks = np.zeros(len(words), bool), words.slice(0, 0), np.empty(0, "S1")
        symbols = np.zeros((len(words), 2), np.int64)
        stems, (runs, run) = letters.dictionary_encode(), np.unique(marks, return_inverse=True)
        parts = [(np.empty(0, np.uint32), np.zeros(1, np.int64))]
        if len(stems.dictionary):
            parts.append(self.merges.encode(stems.dictionary))
        parts.append(self._library([m.decode() for m in runs.tolist()]))
        parts.append(self._library(words.filter(pa.array(~easy)).to_pylist()))
        symbols[easy, 0] = 1 + stems.indices.to_numpy()
        symbols[easy, 1] = 1 + len(stems.dictionary) + run
        symbols[~easy, 0] = 1 + len(stems.dictionary) + len(runs) + np.arange((~easy).sum())
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), symbols

    def ids(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Unsigned 32-bit ids of each text (none null). ASCII white space separates words; what else the tokenizer splits
        at is left to it."""
        ends, at = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)), 0
        while at < len(texts):
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + LETTERS)))
            words = pc.ascii_split_whitespace(texts.slice(at, upto - at))
            coded = words.flatten().dictionary_encode()
            flat, size, symbols = self._symbols(coded.dictionary)
            code = symbols[coded.indices.to_numpy()].ravel()
            n, start = size[code], np.cumsum(size) - size
            stop = np.concatenate([[0], np.cumsum(n)])
            ids = flat[np.repeat(start[code] - stop[:-1], n) + np.arange(stop[-1])]
            bounds = stop[2 * words.offsets.to_numpy()]
            for k in range(upto - at):
                yield ids[bounds[k] : bounds[k + 1]]
            at = upto


def _words(path: str) -> Words:
    if path not in _tokenizers:
        _tokenizers[path] = Words(path)
    return _tokenizers[path]


def pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """PIECE rows of docs (doc_id, text): ids by the tokenizer, END_ID last, cut every `capacity` ids. Null text: empty.

    Repeated rows, and null ids, are cut like others. Extra columns are ignored. Empty table: empty.
    """
    path = vocabulary or default_vocabulary()
    end = np.array([END_ID], "<u4")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(path)
        for batch in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            for row, ids in enumerate(words.ids(pc.fill_null(batch.column(1), ""))):
                ids = np.concatenate([ids, end])
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    rows.append(row)
                    piece.append(k)
                    start.append(at)
                    length.append(len(part))
                    crc.append(zlib.crc32(part))
            doc = batch.column(0).take(pa.array(rows, pa.int64())).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([doc, pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc)]], ["doc_id", "piece", "start", "length", "ids_crc32"])
            released()

    return docs.select("doc_id", "text").mapInArrow(cut, PIECE)


def best_fit(bins: list[list[int]], free: list[int], items: list[int], size, capacity: int) -> None:
    """Puts every item, in the order given, into the bin with the least room that suffices, or into a new bin."""
    open_bins = sorted((f, b) for b, f in enumerate(free) if f > 0)
    for i in items:
        at = bisect.bisect_left(open_bins, (size[i], -1))
        if at < len(open_bins):
            f, b = open_bins.pop(at)
            bins[b].append(i)
            free[b] = f - size[i]
        else:
            b = len(bins)
            bins.append([i])
            free.append(capacity - size[i])
        if free[b] > 0:
            bisect.insort(open_bins, (free[b], b))


def _cross(one, other, size, capacity: int, rng: random.Random):
    """A child of one with whole bins of other, mostly few: (bins, free)."""
    bins, free = other
    full = sorted(range(len(bins)), key=free.__getitem__)[: max(1, len(bins) // 2)]
    chosen = rng.sample(full, 1 + int(rng.random() ** 3 * (len(full) // 2)))
    injected = {i for b in chosen for i in bins[b]}
    child, room, lost = [bins[b] for b in chosen], [free[b] for b in chosen], []
    for items, f in zip(*one, strict=True):
        if injected.isdisjoint(items):
            child.append(items)
            room.append(f)
        else:
            lost += [i for i in items if i not in injected]
    some = [b for b, f in enumerate(room) if f > 0]
    opened = set(rng.sample(some, min(len(some), 1 + len(child) // 50)))  # so that best fit can mend them
    lost += [i for b in opened for i in child[b]]
    child, room = [list(x) for b, x in enumerate(child) if b not in opened], [f for b, f in enumerate(room) if b not in opened]
    best_fit(child, room, sorted(lost, key=lambda i: (-size[i], rng.random())), size, capacity)
    return child, room


def fitness(packing, capacity: int) -> tuple[int, float]:
    """Fewer bins first, then fuller full bins: the sum of squared fills."""
    return -len(packing[0]), float(sum((capacity - f) ** 2 for f in packing[1]))


def founders(size: list[int], capacity: int, seed: int):
    """A first population: best-fit decreasing, and the same with sizes blurred for the order."""
    rng, n, out = random.Random(seed), len(size), []
    for k in range(DEME_SIZE):
        bins: list[list[int]] = []
        free: list[int] = []
        blur = [s * (1 + (0.1 * rng.random() if k else 0)) for s in size]
        best_fit(bins, free, sorted(range(n), key=lambda i: (-blur[i], i)), size, capacity)
        out.append((bins, free))
    return out


def _least(packing, total: int, capacity: int) -> bool:
    """Whether the pieces, of this total, fit no fewer bins, and all but one are filled well."""
    return len(packing[0]) <= -(-total // capacity) and sum(capacity - f < SETTLED * capacity for f in packing[1]) <= 1


def _evolved(population, size: list[int], capacity: int, seed: int):
    """evolve() and the number of crossovers."""
    rng, population, total = random.Random(seed), list(population), sum(size)
    worth, made, idle = [fitness(x, capacity) for x in population], 0, 0
    best, least = max(worth), any(_least(x, total, capacity) for x in population)
    while made < GENERATIONS or not (least or idle >= STALE):
        a, b = rng.sample(range(len(population)), 2)
        child = _cross(population[a], population[b], size, capacity, rng)
        worst, of_child = min(range(len(worth)), key=lambda k: worth[k]), fitness(child, capacity)
        made, idle = made + 1, idle + 1
        if of_child > worth[worst] and of_child not in worth:
            population[worst], worth[worst] = child, of_child
            if of_child > best:
                best, idle, least = of_child, 0, least or _least(child, total, capacity)
    return [population[k] for k in sorted(range(len(worth)), key=lambda k: worth[k], reverse=True)], made


def evolve(population, size: list[int], capacity: int, seed: int):
    """The population, the fittest first, after crossovers until no packing can be better by what counts, or STALE of them in a row
    made none fitter than all others; GENERATIONS at least. A child replaces the least fit if it is fitter and unlike the others.
    """
    return _evolved(population, size, capacity, seed)[0]


def _spelled(packing, n: int) -> bytes:
    where = np.empty(n, "<i4")
    for b, items in enumerate(packing[0]):
        where[items] = b
    return where.tobytes()


def _read(where: bytes, size: list[int], capacity: int):
    bins: list[list[int]] = []
    for i, b in enumerate(np.frombuffer(where, "<i4").tolist()):
        while len(bins) <= b:
            bins.append([])
        bins[b].append(i)
    return bins, [capacity - sum(size[i] for i in items) for items in bins]


def _in_order(pdf: pd.DataFrame) -> pd.DataFrame:
    """A cell's pieces, the largest first; the same order wherever they come from."""
    return pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)


def _settle_in(pdf: pd.DataFrame) -> pd.DataFrame:
    size = np.sort(pdf.length.to_numpy())[::-1].astype("<i8").tobytes()
    return pd.DataFrame([{"island": int(pdf.island.iat[0]), "deme": d, "size": size, "population": [], "bins": 0, "fill": 0.0, "crossovers": 0, "further": 0} for d in range(DEMES)])


def _epoch(level: int, epoch: int, capacity: int):
    """One epoch on each island; its row holds the population, the elite first. guest: an elite that takes the last place."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                size = np.frombuffer(row.size, "<i8").tolist()
                seed = ((row.island * DEMES + row.deme) * EPOCHS + epoch) * 64 + level
                population = [_read(w, size, capacity) for w in row.population] or founders(size, capacity, seed)
                if row.guest is not None:
                    population[-1] = _read(row.guest, size, capacity)
                population, made = _evolved(population, size, capacity, seed)
                bins, fill = fitness(population[0], capacity)
                out.append((row.island, row.deme, row.size, [_spelled(x, len(size)) for x in population], -bins, fill, row.crossovers + GENERATIONS, row.further + made - GENERATIONS))
            yield pd.DataFrame(out, columns=["island", "deme", "size", "population", "bins", "fill", "crossovers", "further"])

    return run


def islands(rest: DataFrame, cells: int, level: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """DEME rows of every cell of rest (PIECE and island) after EPOCHS, elites migrating in between."""
    tasks = max(min(cells * DEMES, 16), -(-cells * DEMES // 8))
    demes = rest.groupBy("island").applyInPandas(_settle_in, DEME).withColumn("guest", F.lit(None).cast("binary"))
    for epoch in range(EPOCHS):
        if epoch:
            elite = demes.select(F.col("island").alias("to"), ((F.col("deme") + 1) % DEMES).alias("next"), F.col("population")[0].alias("guest"))
            demes = demes.join(elite, (F.col("island") == F.col("to")) & (F.col("deme") == F.col("next"))).drop("to", "next")
        demes = written(demes.repartition(tasks, "island", "deme").mapInPandas(_epoch(level, epoch, capacity), DEME), "pack-islands")
    return demes


def _emptiest(packing, size: list[int], capacity: int) -> list[int]:
    """Pieces of bins that aren't filled well, the emptiest first, as long as they are HANDED_ON of all at most."""
    bins, free = packing
    left: list[int] = []
    for b in sorted((b for b, f in enumerate(free) if capacity - f < SETTLED * capacity), key=lambda b: (-free[b], b)):
        if len(left) + len(bins[b]) > HANDED_ON * len(size):
            break
        left += bins[b]
    return left


def _settler(last: bool, level: int, capacity: int):
    def settle(pdf: pd.DataFrame, best: pd.DataFrame) -> pd.DataFrame:
        pdf = _in_order(pdf)
        size = pdf.length.tolist()
        offset, settled = np.zeros(len(pdf), np.int64), np.ones(len(pdf), bool)
        where = np.frombuffer(best.elite.iat[0], "<i4").astype(np.int64)
        packing = _read(best.elite.iat[0], size, capacity)
        for items in packing[0]:
            at = 0
            for i in items:
                offset[i] = at
                at += size[i]
        if not last:
            settled[_emptiest(packing, size, capacity)] = False
        # level, island and bin together are unique: a bin number stays under 2^20, an island's under 2^36
        return pdf.assign(sequence_id=((level << 56) + (int(pdf.island.iat[0]) << 20)) + where, offset=offset, settled=settled)

    return settle


def pack(found: DataFrame, capacity: int = CAPACITY, cell: int = CELL) -> DataFrame:
    """found (PIECE) with sequence_id and offset: a sequence's pieces lie gapless from offset 0, at most capacity together.

    Repeated rows are packed each by itself; ties in length go by doc_id, piece and ids. Extra columns are dropped.
    Empty table: empty.
    """
    found = written(found.select("doc_id", "piece", "start", "length", "ids_crc32"), "pack-pieces")
    n = found.where(F.col("length") < capacity).count()
    # sequences of one full piece have negative numbers, all others have their cell's
    done = found.where(F.col("length") >= capacity).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    cells, level = max(1, -(-n // cell)), 0
    rest = found.where(F.col("length") < capacity).withColumn("island", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(cells)))
    while True:
        last = cells == 1
        demes = islands(rest, cells, level, capacity)
        best = demes.groupBy("island").agg(F.min(F.struct("bins", (-F.col("fill")).alias("unfilled"), "deme", F.col("population")[0].alias("elite"))).alias("x")).select("island", "x.elite")
        out = rest.groupBy("island").cogroup(best.groupBy("island")).applyInPandas(_settler(last, level, capacity), f"{PIECE}, island long, sequence_id long, offset long, settled boolean")
        out = written(out, "pack-level")
        done = done.unionByName(out.where("settled").drop("island", "settled"))
        if last:
            return done
        left = out.where("NOT settled")
        fewer = max(1, -(-left.count() // cell))  # at most HANDED_ON of the cells, and one
        rest = left.drop("sequence_id", "offset", "settled").withColumn("island", F.floor(F.col("island") * F.lit(fewer) / F.lit(cells)))
        cells, level = fewer, level + 1


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed, as the query's contract has it."""
    return pack(pieces(table(spark, sf_dir, "documents")))
