"""The corpus pipeline: toxicity, near-duplicates, secrets, mixing, packing, in this order.

Each stage takes (spark, docs, sf_dir), docs having the columns of documents, and returns a DataFrame: the documents that
go on, all but the last with the same columns. Stages call the operators of the llm subpackage and nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrant.llm import mixing, near_dedup, packing, secrets, toxicity
from quadrant.llm.common import table, written


def _hidden(docs: DataFrame, *used: str) -> tuple[DataFrame, list[Column]]:
    """docs with all columns but those used under names that no operator has, and what turns them back."""
    quoted = lambda c: "`" + c.replace("`", "``") + "`"
    names = {c: c if c in used else f"column {k}" for k, c in enumerate(docs.columns)}
    return docs.select(*[F.col(quoted(c)).alias(n) for c, n in names.items()]), [F.col(quoted(n)).alias(c) for c, n in names.items()]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below its threshold. It learns from the labelled ones among docs."""
    docs, back = _hidden(docs, "doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), ~toxicity.held_out(F.col("doc_id")))
    scored = toxicity.score(docs, model, tuple(c for c in docs.columns if c != "doc_id"))
    return scored.where(F.col("score") < toxicity.THRESHOLD).select(*back)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id; of rows that repeat an id and its text, one.

    Rows without words, or without an id, are no duplicates of anything else.
    """
    docs, back = _hidden(docs, "doc_id", "text")
    found = near_dedup.near_duplicates(docs, NEAR_PERCENT)
    dropped = found.where(~F.col("kept")).select("doc_id").distinct()
    docs = docs.join(dropped, "doc_id", "left_anti")
    again = written(found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "pipeline-repeated")
    single, repeated = docs.join(again, "doc_id", "left_anti"), docs.join(again, "doc_id", "left_semi")
    return single.unionByName(repeated.dropDuplicates(["doc_id", "text"])).select(*back)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret in their texts replaced by a mark, n_chars counted anew where one was."""
    docs, back = _hidden(docs, "doc_id", "text", "n_chars")
    found = secrets.scan(docs, keep=[c for c in docs.columns if c != "doc_id"]).drop("base")
    text = F.when(F.col("text").isNotNull(), secrets.redact(F.col("text"), F.col("spans")))
    found = found.withColumn("redacted", text)
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("redacted").cast("long")).otherwise(F.col("n_chars")))
    return found.withColumn("text", F.col("redacted")).select(*back)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    docs, back = _hidden(docs, "doc_id", "text", "source")
    mixed = mixing.mix(docs, keep=[c for c in docs.columns if c not in ("doc_id", "source")])
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*back)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences."""
    return packing.pack(packing.pieces(docs))


#: Least similarity of near-duplicates, in percent; the query op7 has its own.
NEAR_PERCENT = 80

STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_duplicates), ("secrets", redact_secrets), ("mixing", mix_sources), ("packing", pack_sequences)]

#: Learning a classifier and packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs
