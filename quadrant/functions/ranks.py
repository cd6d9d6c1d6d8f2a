"""Ranks of all rows, or of the rows of each group, without gathering a group, or the whole table, into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrant.sources.shared import written

_IN_PART = (1 << 33) - 1  # the bits in which monotonically_increasing_id() counts a partition's rows


def ranked(df: DataFrame, order: Sequence[str], within: Sequence[str] = (), rank: str = "rank", total: str | None = None) -> DataFrame:
    """df with the rank of each row, from 0, in ascending order of the columns `order`, nulls first, among the rows with
    equal columns `within` (null is a value of its own); total: a column for the number of those rows, if wanted.

    Rows are sorted by range partitions, numbered within each, and moved up by the counts of the partitions before, of
    which there is one row a partition and group. Ties of all columns are ranked in some order, each row once. An empty
    table gives an empty one.
    """
    keys, numbered = [*within, *order], "__at"
    sort = [F.col(c).asc_nulls_first() for c in keys]
    # the last key only deals out rows that tie in all others; whatever it is, such rows may stand in any order
    dealt = df.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(*sort, F.col("__tie")).sortWithinPartitions(*sort)
    rows = written(dealt.drop("__tie").withColumn(numbered, F.monotonically_increasing_id()), "ranked")
    part = F.shiftright(numbered, 33).cast("int").alias("__part")
    counts = rows.groupBy(part, *within).agg(F.min(numbered).alias("__first"), F.count(F.lit(1)).alias("__n"))
    group = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))  # a row a partition of the sort
    before = F.coalesce(F.sum("__n").over(group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    columns = [(F.col("__first").bitwiseAND(_IN_PART) - before).alias("__shift"), F.sum("__n").over(group).alias("__total")]
    starts = counts.select("__part", *[F.col(c).alias(f"__{k}") for k, c in enumerate(within)], *columns)
    starts = starts if within else F.broadcast(starts)
    same = F.shiftright(F.col(numbered), 33).cast("int") == F.col("__part")
    for k, c in enumerate(within):
        same = same & F.col(c).eqNullSafe(F.col(f"__{k}"))
    out = rows.join(starts, same).withColumn(rank, F.col(numbered).bitwiseAND(_IN_PART) - F.col("__shift"))
    out = out.withColumn(total, F.col("__total")) if total else out
    return out.drop(numbered, "__part", "__shift", "__total", *[f"__{k}" for k in range(len(within))])
