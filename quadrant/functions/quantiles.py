"""Exact medians of groups of any size, without gathering a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrant.sources.shared import written

#: Buckets a round and target; rows of a bucket that are few enough to be sorted.
BUCKETS, FEW = 1024, 1000
#: Groups up to this many are broadcast with their bounds.
MOST_BROADCAST = 200_000


def medians(df: DataFrame, group: str, value: str, out: str = "median") -> DataFrame:
    """group, out: the median of the non-null, finite doubles `value` of each group that has one; of an even number the
    mean of the middle two. group may not be null.

    A round counts values by group and bucket, partly where they are, and narrows each group's bounds to the bucket that
    holds the wanted rank; when that holds FEW rows at most, or one value only, those are ranked. Ten rounds take any
    doubles apart.
    """
    rows = written(df.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).where("abs(v) < double('Infinity')"), "median-values")
    found = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    # two targets a group: the ranks, from 0, of the lower and the upper of the middle two
    targets = found.select("g", F.explode(F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2))).alias("rank"), "n", "lo", "hi").distinct()
    targets, done = written(targets, "median-targets"), None
    while True:
        ready = (F.col("n") <= FEW) | (F.col("lo") == F.col("hi"))
        part = targets.where(ready).select("g", "rank", "n", "lo", "hi")
        done = part if done is None else done.unionByName(part)
        targets = targets.where(~ready)
        n = targets.count()
        if not n:
            break
        small = F.broadcast(targets) if n <= MOST_BROADCAST else targets
        met = rows.join(small, "g").where(F.col("v").between(F.col("lo"), F.col("hi")))
        bucket = F.least(F.floor((F.col("v") - F.col("lo")) / F.greatest((F.col("hi") - F.col("lo")) / BUCKETS, F.lit(5e-324))), F.lit(BUCKETS - 1)).alias("bucket")
        counts = met.groupBy("g", "rank", bucket).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("g", "rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # BUCKETS rows a group
        inside = counts.withColumn("before", before).where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n")))
        # a rank within the bucket is one of all its rows, which are those between its least and its greatest
        targets = written(inside.select("g", (F.col("rank") - F.col("before")).alias("rank"), "n", "lo", "hi"), "median-targets")
    same = done.where("lo = hi").select("g", F.col("lo").alias("v"))
    some = done.where("lo < hi")
    n = some.count()
    met = rows.withColumnRenamed("v", "value").join(F.broadcast(some) if n <= MOST_BROADCAST else some, "g").where("value BETWEEN lo AND hi")
    nr = F.row_number().over(Window.partitionBy("g", "rank", "lo", "hi").orderBy("value")) - 1  # FEW rows a target
    picked = met.withColumn("nr", nr).where("nr = rank").select("g", F.col("value").alias("v"))
    return same.unionByName(picked).groupBy("g").agg(F.avg("v").alias(out)).withColumnRenamed("g", group)
