"""Document fingerprints from closed syncmers.

A k-mer is K characters in a row. Its inner substrings are the K-S+1 runs of S characters; it is a closed syncmer if the
least hash among them is that of the first or the last. Whether a k-mer is one depends on nothing but itself, so an edit
moves no anchors but those of k-mers that it touches, in texts with or without spaces, and 2 in K-S+1 k-mers are anchors
whatever the text.

The fingerprint is all anchors in order, each with its distance to the next one: positions, but for where the text begins.
Two texts match at an anchor if both have it at the same distance from the same next anchor, so a passage matches wherever
it stands, and its characters only in their order. Hashes and minima are arrays, one element a character: minima over 32
places come from those over 4. Long texts are walked in chunks of CHUNK characters, which changes nothing: an anchor belongs
to the chunk where its k-mer starts. Nor does a text put together from parts of others need a walk, but for where they meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrant.llm.common import WORD, let, table

S, WINDOW = 4, 32
K = S + WINDOW - 1
CHUNK = 1 << 15
#: Rows a bucket of neighbouring ids, and the most buckets; the table with a row a bucket is broadcast, so this bounds it.
BUCKET_ROWS, MOST_BUCKETS, CUTS = 256, 1 << 20, 1024
ANCHORS = "array<struct<position:int,hash:bigint>>"


def _runs(text: Column) -> Column:
    """Hash of each run of S characters. A regular expression gives the runs at once, but where characters beyond 16 bits
    stand, it would also stop between their halves."""
    quick = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{S}}}))"), F.lit(1))
    slow = let(F.split(text, ""), lambda c: F.transform(F.slice(c, 1, F.greatest(F.size(c) - (S - 1), F.lit(0))), lambda x, i: F.concat(x, *[F.get(c, i + k) for k in range(1, S)])))
    return F.transform(F.when(text.rlike("[\\x{10000}-\\x{10FFFF}]"), slow).otherwise(quick), lambda r: F.xxhash64(r))


def _anchors(text: Column) -> Column:
    """ANCHORS of a text of K characters or more, in order."""

    def of(inner: Column) -> Column:
        whole = lambda i: F.xxhash64(*[F.get(inner, i + k) for k in range(0, WINDOW, S)], F.get(inner, i + (WINDOW - 1)))  # noqa: E731  # these hold all K characters
        four = F.transform(inner, lambda x, i: F.least(x, *[F.get(inner, i + k) for k in range(1, 4)]))  # null, behind the end, counts for nothing
        # the least of the window is the least of its edges
        edges = lambda m: F.array_compact(F.transform(m, lambda x, i: F.when(F.least(x, *[F.get(m, i + k) for k in range(4, WINDOW, 4)]) == F.least(F.get(inner, i), F.get(inner, i + (WINDOW - 1))), i)))
        return let(F.size(inner) - WINDOW, lambda last: F.transform(F.filter(let(four, edges), lambda i: i <= last), lambda i: F.struct(i.alias("position"), whole(i).alias("hash"))))

    return let(_runs(text), of)


def syncmers(text: Column) -> Column:
    """ANCHORS: the closed syncmers in order, position being that of the first character (from 0). Null: null."""

    def chunk(i: Column) -> Column:
        return let(F.substring(text, i * CHUNK + 1, F.lit(CHUNK + K - 1)), lambda t: F.when(F.length(t) >= K, F.transform(_anchors(t), lambda a: F.struct((a["position"] + i * CHUNK).alias("position"), a["hash"].alias("hash")))).otherwise(F.array().cast(ANCHORS)))

    last = F.floor(F.greatest(F.length(text) - K, F.lit(0)) / CHUNK).cast("int")
    return F.flatten(F.transform(F.sequence(F.lit(0), last), chunk))


def joined(text: Column, anchors: Column, upto: Column, more: Column, more_anchors: Column, more_upto: Column) -> Column:
    """ANCHORS of the first upto characters of text and the first more_upto of more behind them, given those of both."""

    def of(at: Column) -> Column:  # bound once: a length is a walk over the text
        n, m, begin, seam = at["n"], at["m"], at["begin"], at["seam"]
        within = lambda a, upto, by: F.transform(F.filter(a, lambda x: x["position"] + K <= upto), lambda x: F.struct((x["position"] + by).alias("position"), x["hash"].alias("hash")))
        return F.concat(within(anchors, n, F.lit(0)), within(syncmers(seam), at["seam_size"], begin), within(more_anchors, m, n))

    def meet(at: Column) -> Column:
        begin = F.greatest(at["n"] - (K - 1), F.lit(0))
        seam = F.concat(F.substring(text, begin + 1, at["n"] - begin), F.substring(more, F.lit(1), F.least(at["m"], F.lit(K - 1))))
        return F.struct(at["n"].alias("n"), at["m"].alias("m"), begin.alias("begin"), seam.alias("seam"), (at["n"] - begin + F.least(at["m"], F.lit(K - 1))).alias("seam_size"))

    return let(F.struct(upto.alias("n"), more_upto.alias("m")), lambda at: let(meet(at), of))


def sketch(text: Column, anchors: Column | None = None) -> Column:
    """array<bigint>: for each anchor, 32 bits of its hash above its distance to the next; 0 for the last one's.

    A text without an anchor, as all of fewer than K characters are: the hash of the whole. Empty text: empty. anchors: the
    text's, where they are known.
    """

    def gaps(a: Column) -> Column:
        following = F.transform(a, lambda x, i: F.struct(x["hash"].alias("hash"), F.coalesce(F.get(a, i + 1)["position"] - x["position"], F.lit(0)).cast("long").alias("gap")))
        return F.transform(following, lambda x: F.shiftleft(F.shiftrightunsigned(x["hash"], 32), 32).bitwiseOR(x["gap"]))

    whole = F.array(F.shiftleft(F.shiftrightunsigned(F.xxhash64(text), 32), 32))
    return F.when(F.length(text) == 0, F.array().cast("array<bigint>")).otherwise(let(syncmers(text) if anchors is None else anchors, lambda a: F.when(F.size(a) > 0, gaps(a)).otherwise(whole)))


def spelled(sketched: Column) -> Column:
    """A sketch as text: 64 bits an anchor in hexadecimal digits, the upper half the hash, the lower the distance to the next."""
    return F.array_join(F.transform(sketched, lambda x: F.hex(x)), " ")


def likeness(a: Column, b: Column) -> Column:
    """Share of anchors matched, with the distance to the next, among the distinct ones of either. Two empty sketches: 1;
    one: 0."""
    shared = F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).when(a == b, 1.0).otherwise(shared)


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, anchors, sketch, next_text, next_anchors, next_sketch: each row with the next by doc_id, then text; the first after the last.

    Ids are cut at quantiles into buckets of BUCKET_ROWS rows on average, so every row is shuffled once, however unevenly
    the ids lie; each bucket also gets the first row of the next bucket that has any. Rows of one id share a bucket.
    Null text: empty. Null doc_id: before all others. Repeated rows: each by itself, next to each other. Other columns are
    dropped. Empty table: empty.
    """
    bucket = _buckets(docs)
    # null goes before all others: no id has the key that it gets
    key = F.struct(F.col("doc_id").isNotNull().alias("real"), F.coalesce("doc_id", F.lit(0)).alias("id"))
    x = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), key.alias("key"), bucket.alias("bucket"))
    every = Window.orderBy("bucket")  # a row a bucket, at most MOST_BUCKETS
    first = x.groupBy("bucket").agg(F.min("key").alias("first_key"))
    first = first.select("first_key", F.coalesce(F.lag("bucket").over(every), F.max("bucket").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("to"), F.lag("bucket").over(every).isNull().alias("wraps"))
    x = x.join(F.broadcast(first), x.key == first.first_key, "left")
    own = F.struct(F.col("bucket").alias("at"), F.lit(False).alias("wraps"), F.lit(False).alias("guest"))
    guest = F.struct(F.col("to").alias("at"), F.col("wraps").alias("wraps"), F.lit(True).alias("guest"))
    x = x.select("doc_id", "text", "key", F.explode(F.when(F.col("to").isNotNull(), F.array(own, guest)).otherwise(F.array(own))).alias("p"))
    x = x.select("doc_id", "text", "key", "p.*").repartition("at").withColumn("anchors", syncmers(F.col("text"))).withColumn("sketch", sketch(F.col("text"), F.col("anchors")))
    order = Window.partitionBy("at").orderBy("wraps", "key", "text", "guest")
    x = x.withColumns({"next_text": F.lead("text").over(order), "next_anchors": F.lead("anchors").over(order), "next_sketch": F.lead("sketch").over(order)})
    return x.where(~F.col("guest")).select("doc_id", "text", "anchors", "sketch", "next_text", "next_anchors", "next_sketch")


def _buckets(docs: DataFrame) -> Column:
    """The bucket of a row by its doc_id: quantiles part the ids coarsely, and equal widths within two of them finely."""
    span = docs.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("n")).first()
    parts = min(CUTS, span.n // BUCKET_ROWS)
    if span.lo is None or parts < 2:
        return F.lit(0).cast("long")
    found = docs.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], 20 * parts)).first()[0]
    cuts = sorted({c for c in found if span.lo < c})
    bounds = F.array(*[F.lit(c).cast("long") for c in [span.lo, *cuts, span.hi]])
    each = max(1, min(MOST_BUCKETS // (len(cuts) + 1), span.n // (len(cuts) + 1) // BUCKET_ROWS))
    own = F.coalesce("doc_id", F.lit(span.lo)).cast("long")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))])
    # by halving: how many cuts are not above the id
    coarse = F.aggregate(steps, F.lit(0), lambda at, by: F.when((at + by <= len(cuts)) & (F.element_at(bounds, F.least(at + by, F.lit(len(cuts))) + 1) <= own), at + by).otherwise(at)) if cuts else F.lit(0)

    def fine(c: Column) -> Column:
        lo, hi = (F.element_at(bounds, c + k).cast("double") for k in (1, 2))
        return c * each + F.least(F.floor((own.cast("double") - lo) / F.greatest(hi - lo, F.lit(1.0)) * each), F.lit(each - 1)).cast("long")

    return let(coarse, fine).cast("long")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, as the query's contract has it."""
    x = with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    taken = F.least(half, F.length("next_text"))
    x = x.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)))
    x = x.withColumn("edited_anchors", joined(F.col("text"), F.col("anchors"), n - half, F.col("next_text"), F.col("next_anchors"), taken))
    x = x.withColumn("edited_sketch", sketch(F.col("edited"), F.col("edited_anchors")))
    return x.select("doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), spelled(F.col("sketch")).alias("fingerprint"), spelled(F.col("edited_sketch")).alias("edited_fingerprint"), likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"))
