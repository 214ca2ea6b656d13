"""Bounded, documented training samples and the split by crc32 of the document id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of whole texts that a sample holds at most, whatever its number of rows.
SAMPLE_BYTES = 64 << 20


def remainder(doc_id: str | Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % mod


def training_ids(rows: DataFrame, limit: int, mod: int, hold: int) -> DataFrame:
    """At most ``limit`` distinct ids of ``rows`` that are not held out, in the order of their hash, with all columns."""
    own = rows.where(F.col("doc_id").isNotNull() & (remainder("doc_id", mod) != hold))
    return own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def sampled(documents: DataFrame, ids: DataFrame, max_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(doc_id, text, the other columns of ``ids``), one row for each id, ids in the order of their hash.

    ``ids`` is bounded and holds each id once. Of the rows of an id the smallest text is taken. Whole texts are taken
    until the next one would exceed ``max_bytes``; longer texts than that are never part of a sample.
    """
    rows = documents.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(ids.select("doc_id")), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"))
    # Ids and lengths alone meet in one order; texts join what is taken of them.
    light = rows.select("doc_id", F.octet_length("text").cast("long").alias("__size"))
    upto = F.sum("__size").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))
    taken = light.where(F.col("__size") <= max_bytes).withColumn("__upto", upto).where(F.col("__upto") <= max_bytes).select("doc_id")
    return rows.join(F.broadcast(taken), "doc_id").join(F.broadcast(ids), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id")


def labelled(documents: DataFrame, labels: DataFrame, label: str, limit: int, mod: int = 4, hold: int = 2) -> DataFrame:
    """At most ``limit`` labelled training rows (doc_id, text, y); of several labels of an id the largest holds."""
    ids = labels.where(F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    return sampled(documents, training_ids(ids, limit, mod, hold))
