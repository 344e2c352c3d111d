"""Lines repeated across documents, dropped everywhere but in one document.

All of it is DataFrame work.  A line's key becomes a 128-bit hash.  Hashes are range
partitioned and sorted by document and position, so one pass over a partition sees
the keeping document of each key first and streams on; what comes out are only the
positions to drop, packed per document into 32-bit words (words without a dropped
line are left out).  Texts are not moved for the decision.

Keys that may hold a large share of all lines come from a frequent-items sketch; they
skip the range partitions and go through partial aggregation and a broadcast of one
row a key (``HOT_KEYS`` at most).  Both ways give the same answer for any key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\f\r"
HOT_KEYS = 1000
_TRACKED = 8192
_BITS = 32


def _tag(text: Column) -> Column:
    """Tells apart rows that share an id; repeated rows share the tag and the answer."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def postings(docs: DataFrame, min_length: int, id_col: str, text_col: str) -> DataFrame:
    """(h1, h2, doc, tag, pos): a row for each line whose key is long enough."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d = docs.select(
        F.col(id_col).alias("doc"), _tag(F.col(text_col).cast("string")).alias("tag"),
        F.posexplode(F.split(F.translate(text, UPPER, LOWER), "\n")).alias("pos", "line"),
    )
    d = d.select("doc", "tag", "pos", F.btrim("line", F.lit(BLANKS)).alias("key")).where(F.char_length("key") >= min_length)
    return d.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc", "tag", "pos")


def _frequent(p: DataFrame) -> DataFrame:
    """At most HOT_KEYS values of h1, among them all with more than about a 3000th of the rows."""
    top = p.agg(F.expr(f"approx_top_k(h1, {HOT_KEYS}, {_TRACKED})").alias("t"), F.count("*").alias("n"))
    hot = top.select("n", F.explode("t").alias("t")).where(f"t.count * {_TRACKED // 2} >= n and t.count > 2")
    return hot.select(F.col("t.item").alias("h1"))


def keep_bitmaps(docs: DataFrame, min_length: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, tag, words): dropped lines of the documents that lose any.

    ``words`` is a sorted array of (word, bits); bit b of word w set means that line
    32*w + b goes.  ``tag`` is the hash of the text.
    """
    p = materialize(postings(docs, min_length, id_col, text_col), "postings")
    hot = materialize(_frequent(p), "frequent")
    keys = ["h1", "h2"]

    cold = p.join(F.broadcast(hot), "h1", "left_anti").repartitionByRange(*keys)
    run = Window.partitionBy(*keys).orderBy(F.desc_nulls_last("doc"), "tag", "pos")
    whole = Window.partitionBy(*keys)
    cold = cold.withColumn("new", F.when(F.lag(F.struct("doc")).over(run).eqNullSafe(F.struct("doc")), 0).otherwise(1))
    cold = cold.withColumn("n", F.sum("new").over(whole)).withColumn("keeper", F.max("doc").over(whole))

    often = p.join(F.broadcast(hot), "h1", "left_semi")
    stats = often.groupBy(*keys, "doc").agg(F.lit(1).alias("one")).groupBy(*keys).agg(F.count("*").alias("n"), F.max("doc").alias("keeper"))
    often = often.join(F.broadcast(stats), keys)

    cols = ["doc", "tag", "pos", "n", "keeper"]
    gone = cold.select(*cols).unionByName(often.select(*cols))
    gone = gone.where((F.col("n") >= min_docs) & ~F.col("doc").eqNullSafe(F.col("keeper")))
    word = F.expr(f"pos div {_BITS}")
    bits = gone.groupBy("doc", "tag", word.cast("int").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, pos % {_BITS})")).alias("bits"))
    return bits.groupBy("doc", "tag").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("words"))


def drop_repeated_lines(docs: DataFrame, min_length: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated lines gone from the text.

    A line's key is the line without ASCII white space at its ends, A-Z lower-cased.
    Keys of ``min_length`` code points or more found in ``min_docs`` documents (distinct
    ids) lose all their lines except in the largest id.  Returns a struct column
    ``doc`` (the input row), ``kept`` (the text of the lines that stay), ``n_lines`` and
    ``n_dropped``.

    Null or empty text is one empty line.  A null id is one document, below all others.
    Repeated rows get the same answer each and count once.  Empty table: no rows.
    Extra columns stay inside ``doc`` whatever their names.
    """
    maps = keep_bitmaps(docs, min_length, min_docs, id_col, text_col).select(
        F.col("doc").alias("_id"), F.col("tag").alias("_tag"), F.col("words").alias("_words")
    )
    text = F.col(f"doc.{text_col}").cast("string")
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    d = d.withColumns({"_tag1": _tag(text), "_text": F.coalesce(text, F.lit(""))})
    d = d.join(maps, F.col(f"doc.{id_col}").eqNullSafe(F.col("_id")) & (F.col("_tag1") == F.col("_tag")), "left")
    lines = F.split("_text", "\n")
    d = d.withColumn("n_lines", F.size(lines).cast("long"))
    sparse = F.map_from_entries("_words")
    dense = F.transform(F.sequence(F.lit(0), F.expr(f"cast((n_lines - 1) div {_BITS} as int)")), lambda w: F.coalesce(F.try_element_at(sparse, w), F.lit(0).cast("long")))
    d = d.withColumn("_dense", F.when(F.col("_words").isNotNull(), dense))
    stays = F.filter(lines, lambda _, i: F.expr("1").cast("long").bitwiseAND(F.call_function(
        "shiftrightunsigned", F.element_at("_dense", (F.floor(i / _BITS) + 1).cast("int")), i % _BITS)) == 0)
    d = d.withColumn("_stays", F.when(F.col("_words").isNotNull(), stays))
    return d.select(
        "doc", F.when(F.col("_words").isNull(), F.col("_text")).otherwise(F.array_join("_stays", "\n")).alias("kept"), "n_lines",
        F.coalesce(F.col("n_lines") - F.size("_stays"), F.lit(0)).cast("long").alias("n_dropped"),
    )
