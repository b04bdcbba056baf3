"""Labelled documents for the models of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: str = "doc_id"):
    """True for the fifth of the documents that no model learns from; a null doc_id counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """``doc_id, text, label`` of at most ``rows`` labelled documents that aren't held out.

    The rows with the smallest hash of doc_id are taken, the same on each run. A doc_id with several labels has the
    smallest; null labels and doc_ids are ignored. ``rows`` bounds what is broadcast.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .where(~held_out())
        .groupBy("doc_id")
        .agg(F.min(label).alias("label"))
        .orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id")
        .limit(rows)
    )
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")
