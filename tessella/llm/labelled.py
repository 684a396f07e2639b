"""Bounded labelled samples to fit classifiers on, and the split that holds rows out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def sample(labels: DataFrame, label: str, trainable: Column, most: int) -> DataFrame:
    """``doc_id``, ``y``: at most ``most`` labelled ids of each class, the first by hash among the trainable.

    Labels other than 0 and 1, and null ids, are left out; an id with several labels takes the largest. The result
    has at most 2 * most rows, which is why callers may broadcast it.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & trainable)
    parts = [rows.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for y in (0, 1)]
    return parts[0].unionAll(parts[1]).groupBy("doc_id").agg(F.max("y").alias("y"))


def labelled(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """``doc_id``, ``text``, ``y`` of the chosen ids, one row each: of rows that repeat an id the least text.

    The bounded side is broadcast, so only texts of chosen ids are ever sorted or shuffled.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "text", "y")
