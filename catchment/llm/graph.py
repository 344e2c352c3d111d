"""Connected components by alternating star contractions, a table per round."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import materialize, release


def _to_least(e: DataFrame, both: bool) -> DataFrame:
    """Tie every neighbour of a node to the least one around it.

    ``both``: neighbours above the node move (large star); otherwise those below
    it and the node itself (small star).  ``e`` holds (u, v) with u > v.
    """
    n = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both else e
    least = n.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    moved = n.join(least, "u")
    if both:
        out = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) links -> (node, component), the least node reachable; roots are not listed.

    Nulls and self-links are ignored; no link gives no row.  Rounds grow with the
    logarithm of the longest path.
    """
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e, stamp = materialize(e, "links"), None
    while True:
        now = e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if now == stamp or not now[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        stamp, last = now, e
        e = materialize(_to_least(_to_least(e, True), False), "links")
        release(last)
