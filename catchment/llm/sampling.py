"""Bounded samples of labelled rows, the same rows in every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def id_remainder(id_col: Column, divisor: int) -> Column:
    """crc32 of the id's decimal text, modulo ``divisor``."""
    return F.crc32(id_col.cast("string").cast("binary")) % divisor


def bounded(rows: DataFrame, most: int, *keys: str) -> DataFrame:
    """``most`` rows at most, those with the least hash of ``keys``; a small top-k on every task."""
    return rows.orderBy(F.xxhash64(*keys), *keys).limit(most)


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, keep: Column, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, label) of at most ``most`` labelled documents.

    ``keep`` is a condition on ``doc_id`` and ``label``.  The sample is drawn from the
    labels, so it can be broadcast (``most`` rows of two numbers) and no text is moved.
    Rows without id or label are left out; of repeated labels of an id the largest counts.
    """
    picked = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    picked = picked.where("doc_id is not null and label is not null").where(keep).groupBy("doc_id").agg(F.max("label").alias("label"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.join(F.broadcast(bounded(picked, most, "doc_id")), "doc_id")
