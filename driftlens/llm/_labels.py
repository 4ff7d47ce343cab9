"""Bounded, reproducible samples of labelled rows, shared by the three trained scorers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: One row in FOLDS is held out: crc32 of doc_id, as text, modulo FOLDS is 0.
FOLDS = 5


def held_out(doc_id="doc_id"):
    """True on the rows that no fit may see; a null doc_id is never labelled and counts as not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == 0, F.lit(False))


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """(doc_id, text, label) of at most ``rows`` training documents, one row a document.

    The documents with the smallest hash of doc_id are taken, so a run repeats exactly; ``rows`` bounds the
    broadcast side of the join and the result. Repeated label rows of a document count once (the smallest
    label), repeated document rows count once (the smallest text; null only if every text is). Null labels and
    null ids are ignored.
    """
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.min(label).cast("double").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    return documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
