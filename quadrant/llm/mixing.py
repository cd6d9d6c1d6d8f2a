"""Mixing sources to target weights by hash-threshold histograms.

Every row has a fixed 30-bit hash. For each source the words in each hash bucket are summed (a map-side combined
aggregate of at most 1024 rows a source and task); the bucket in which the running sum crosses the source's budget is
the boundary bucket, and only its rows are summed again by the next ten bits, three levels in all. What comes out is
one threshold a source, so the mix is a filter: no row is ever sorted or ranked. A larger budget has a larger
threshold, so the mixes for growing budgets are nested.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrant.llm.common import WORD, table, written

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
LEVEL_BITS, LEVELS = 10, 3
FEW_SOURCES = 100_000  # rows of five numbers and a name, which may be broadcast


def word_count(text: Column) -> Column:
    """The number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(by_source: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Budgets by source, from (source, source_size): min(most * source_size, weight * level), one level for all.

    Weights repeat over the sources by code point, null last. The level is where the budgets come to share * all
    sizes; handing the excess of full sources on by weight until none is above its most ends there. Sources in the
    order of most * source_size / weight fill up one after another, so running sums give the level. The table has a
    row a source, and no text, so its two windows may run in one task. All sizes 0: all budgets 0.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    every = Window.partitionBy(F.lit(0))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    x = by_source.withColumn("weight", w).withColumn("most", F.col("source_size") * F.lit(float(most)))
    x = x.withColumn("full_at", F.col("most") / F.col("weight"))
    rising = Window.orderBy("full_at", F.col("source").isNull(), F.col("source"))
    x = x.withColumns({"all_size": F.sum("source_size").over(every) * F.lit(float(share)), "all_weight": F.sum("weight").over(every), "most_so_far": F.sum("most").over(rising), "weight_so_far": F.sum("weight").over(rising)})
    # the level if exactly the sources up to this one were full; it holds where the next one wouldn't be
    level = (F.col("all_size") - (F.col("most_so_far") - F.col("most"))) / (F.col("all_weight") - (F.col("weight_so_far") - F.col("weight")))
    x = x.withColumns({"level": level, "place": F.row_number().over(rising)})
    fits = F.col("level") <= F.col("full_at")  # the first for which it holds
    x = x.withColumn("level", F.min_by(F.when(fits, F.col("level")), F.when(fits, F.col("place"))).over(every))
    return x.select("source", "source_size", F.least("most", F.coalesce(F.col("weight") * F.col("level"), F.col("most"))).alias("target"))


def _threshold(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, bound): rows whose hash is below bound together come nearest to `need` words of the source."""
    at, level = budgets.select("source", "need", F.lit(0).cast("long").alias("bound"), F.lit(0).cast("long").alias("below")), 0
    while level < LEVELS:
        shift = (LEVELS - 1 - level) * LEVEL_BITS
        rows = sized
        if level:  # only the rows of the boundary bucket
            edge = at.select(F.col("source").alias("s"), F.shiftright("bound", shift + LEVEL_BITS).alias("edge"))
            rows = sized.join(edge, sized.source.eqNullSafe(edge.s) & (F.shiftright("hash", shift + LEVEL_BITS) == edge.edge), "left_semi")
        sums = rows.groupBy("source", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("words"))
        base = at.withColumnRenamed("source", "s")
        sums = sums.join(base, sums.source.eqNullSafe(base.s)).drop("s")
        so_far = F.col("below") + F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
        sums = sums.withColumn("upto", so_far)
        # the first bucket in which the running sum passes the budget
        crossing = sums.where("upto > need").groupBy("source").agg(F.min_by(F.struct((F.col("upto") - F.col("words")).alias("below"), "upto", "bucket"), "bucket").alias("x"))
        crossing = crossing.select(F.col("source").alias("s"), "x.*")
        last = level == LEVELS - 1
        take_it = (F.col("x_upto") - F.col("need") < F.col("need") - F.col("x_below")) if last else F.lit(False)
        edge = crossing.select("s", F.col("below").alias("x_below"), F.col("upto").alias("x_upto"), (F.col("bucket") * (1 << shift)).alias("x_bound"))
        joined = at.join(edge, at.source.eqNullSafe(edge.s), "left")
        # nothing crosses: all rows of the source at level 0; later, the end of the boundary bucket can't be passed
        at = joined.select("source", "need", F.when(F.col("x_bound").isNull(), F.col("bound") if level else F.lit(1 << (LEVELS * LEVEL_BITS))).otherwise(F.col("x_bound") + F.when(take_it, 1).otherwise(0)).cast("long").alias("bound"), F.coalesce("x_below", "below").alias("below"))
        at = written(at, "mix-threshold")
        level += 1
    return at.select("source", "bound")


def mix(docs: DataFrame, size: Column | None = None, weights=WEIGHTS, share: float = SHARE, most: float = MOST, keep: list[str] | None = None) -> DataFrame:
    """How much of each row the mix takes: doc_id, source, size, source_size, target, copies, taken, plus `keep`.

    size is the row's words unless given. A budget of q times the source plus a rest takes each row floor(q) times, and
    once more where its hash is below the source's threshold for the rest; so no row is taken more than `most` times.
    Equal rows have equal hashes and are taken alike. Null text: size 0. Null source: a source of its own, the last.
    Null doc_id: hashed by its text. Empty table: empty.
    """
    named = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit("")))
    hashed = F.shiftright(F.conv(F.substring(named, 1, 8), 16, 10).cast("long"), 32 - LEVELS * LEVEL_BITS)
    measured = ["doc_id", "source", (word_count(F.col("text")) if size is None else size).cast("long").alias("size"), hashed.alias("hash")]
    sized = written(docs.select(*measured), "mix-sizes")
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    budgets = targets(by_source, weights, share, most)
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(0)
    budgets = written(budgets.withColumn("whole", whole.cast("long")).withColumn("need", F.col("target") - F.col("whole") * F.col("source_size")), "mix-budgets")
    bounds = _threshold(sized.select("source", "size", "hash"), budgets)
    per = budgets.join(bounds.withColumnRenamed("source", "s"), budgets.source.eqNullSafe(F.col("s")))
    per = written(per.select(F.col("source").alias("per_source"), "source_size", "target", "whole", "bound"), "mix-sources")
    if per.count() <= FEW_SOURCES:  # else they are joined by a shuffle
        per = F.broadcast(per)
    # texts go through no table: what was measured of them is measured again, where it is asked for
    out = docs.select(*measured, *keep) if keep else sized
    out = out.join(per, out.source.eqNullSafe(F.col("per_source")))
    copies = F.least(F.col("whole") + F.when(F.col("hash") < F.col("bound"), 1).otherwise(0), F.lit(most)).cast("long")
    return out.withColumn("copies", copies).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *(keep or []))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents, as the query's contract has it."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source", "source_size", "target", "copies", "taken")


#: The same thresholds from a running sum over all hashes, which a histogram level by level saves Spark.
SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
      CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 8) AS BIGINT) >> 2 AS h FROM documents),
  s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
  w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS weight, source_size * 2.0::DOUBLE AS most FROM s),
  f AS (SELECT *, most / weight AS full_at FROM w),
  r AS (SELECT *, sum(source_size) OVER () * 1.5::DOUBLE AS all_size, sum(weight) OVER () AS all_weight, sum(most) OVER o AS most_so_far, sum(weight) OVER o AS weight_so_far, row_number() OVER o AS place
      FROM f WINDOW o AS (ORDER BY full_at, source IS NULL, source)),
  v AS (SELECT *, (all_size - (most_so_far - most)) / (all_weight - (weight_so_far - weight)) AS level FROM r),
  t AS (SELECT source, source_size, least(most, coalesce(weight * (SELECT level FROM v WHERE level <= full_at ORDER BY place LIMIT 1), most)) AS target FROM v),
  q AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2) ELSE 0 END AS whole FROM t),
  b AS (SELECT *, target - whole * source_size AS need FROM q),
  g AS (SELECT source, h, sum(size) AS words FROM d GROUP BY 1, 2),
  c AS (SELECT source, h, words, sum(words) OVER (PARTITION BY source ORDER BY h) AS upto FROM g),
  x AS (SELECT c.source, min_by({'h': c.h, 'upto': c.upto, 'below': c.upto - c.words}, c.h) AS e FROM c JOIN b ON c.source IS NOT DISTINCT FROM b.source WHERE c.upto > b.need GROUP BY 1),
  k AS (SELECT b.*, CASE WHEN e IS NULL THEN 1073741824 ELSE e.h + CASE WHEN e.upto - need < need - e.below THEN 1 ELSE 0 END END AS bound FROM b LEFT JOIN x ON x.source IS NOT DISTINCT FROM b.source)
SELECT d.doc_id, d.size, d.source, k.source_size, k.target, CAST(least(k.whole + CASE WHEN d.h < k.bound THEN 1 ELSE 0 END, 2) AS BIGINT) AS copies,
  CAST(least(k.whole + CASE WHEN d.h < k.bound THEN 1 ELSE 0 END, 2) * d.size AS BIGINT) AS taken
FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source
"""
