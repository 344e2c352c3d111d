"""Training-corpus pipeline: each stage works on all that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from catchment.llm.bpe import encode_documents
from catchment.llm.decontaminate import find_leaks
from catchment.llm.line_dedup import drop_repeated_lines
from catchment.llm.near_dup import near_duplicates
from catchment.llm.queries import table, toxic_lexicon
from catchment.llm.toxicity import reject_toxic
from catchment.session import materialize, release

#: Documents that score so much or more are rejected as toxic.
TOXIC_FROM = 0.7


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go.  The lexicon is learned from ``labels`` and the documents given.

    Null and empty texts stay; without labels nothing is toxic; repeated rows share their fate.
    """
    return reject_toxic(docs, toxic_lexicon(docs, table(spark, sf_dir, "labels")), TOXIC_FROM)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines repeated across documents go, and with them documents that have only blanks besides.

    Documents that lose no line stay as they are, empty and null texts too.
    """
    blank = F.lit(" \t\n\x0b\f\r")
    rows = drop_repeated_lines(docs).where((F.col("n_dropped") == 0) | (F.btrim("kept", blank) != ""))
    cut = F.col("n_dropped") > 0
    new = {"text": F.col("kept"), "n_chars": F.char_length("kept").cast("long")}
    return rows.select(*[(F.when(cut, new[c]).otherwise(F.col(f"doc.`{c}`")) if c in new else F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the least id.

    Null and wordless texts and rows without id stay; rows that share an id are one document.
    """
    gone = near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of ``benchmark`` go; null texts and rows without id stay."""
    leaks = find_leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti").select(docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document's text, and whether they decode to it; null texts have no ids.

    As the last stage it returns (doc_id, lang, source, n_tokens, ids, intact) and no other column.
    """
    rows = encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, check_col="intact")
    return rows.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "intact")


#: Every stage takes empty tables and leaves extra columns alone, up to the last.
STAGES = [
    ("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("byte_bpe", byte_bpe),
]
#: The lexicon, near copies on whole sets and byte-pair merges are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs, last = materialize(stage(spark, docs, sf_dir), name), docs
        release(last)
    return docs
