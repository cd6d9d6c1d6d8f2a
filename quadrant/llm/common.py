"""What the operators of this subpackage share: reading tables, shared intermediate tables, let-bindings for SQL lambdas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrant.sources.shared import shared_dir, written  # noqa: F401

#: A word is a maximal run of anything but ASCII white space; the same class everywhere, in Java's and in Python's syntax.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder. Only Spark opens the path, so that it may lie in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def released() -> None:
    """Gives a worker's unused Arrow memory back: it lives on, and serves other stages beside the executor's heap."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()


def let(value: Column, body) -> Column:
    """body(value), with value computed once: a lambda's variable is evaluated once, an expression at each mention."""
    return F.transform(F.array(value), body)[0]


def running(sizes: Column) -> Column:
    """Sums of an array of ints up to each of its elements.

    Spark has no running sum within a row, and appending to an array copies it; so sums are built in chunks of about
    the root of the length, which costs n^1.5 element copies instead of n^2.
    """
    step = lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["got"], F.array(a["at"] + x)).alias("got"))
    sums = lambda xs, start: F.aggregate(xs, F.struct(start.alias("at"), F.array().cast("array<int>").alias("got")), step)["got"]

    def chunked(x: Column) -> Column:
        each = F.greatest(F.ceil(F.sqrt(F.size(x).cast("double"))), F.lit(1)).cast("int")

        def of(k: Column) -> Column:
            chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / k).cast("int")), lambda i: F.slice(x, i * k + 1, k))

            def place(c: Column) -> Column:
                totals = F.transform(c, lambda part: F.aggregate(part, F.lit(0), lambda a, v: a + v))
                return let(sums(totals, F.lit(0)), lambda ends: F.flatten(F.transform(c, lambda part, i: sums(part, F.when(i == 0, F.lit(0)).otherwise(F.element_at(ends, F.greatest(i, F.lit(1)).cast("int")))))))

            return let(chunks, place)

        return F.when(F.size(x) > 0, let(each, of)).otherwise(F.array().cast("array<int>"))

    return let(sizes, chunked)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.translate(text, UPPER, LOWER)
