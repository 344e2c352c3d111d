"""Merging point-of-interest providers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.text import name_similar
from .nearest import nearest_site

# Fixed value: two records closer than this with similar names are one place.
DEDUP_RADIUS_M = 50.0


def merge_providers(left: DataFrame, right: DataFrame, radius_m: float = DEDUP_RADIUS_M, keys=("aoi_id",)) -> DataFrame:
    """Union of two providers without the right rows that repeat a left one.

    Columns: keys, poi_id, name, amenity, lon, lat, sources (array).  A right
    row is a repeat when its nearest left row is within the radius and the names
    agree; the left row then also carries the right row's sources.  Only the
    nearest row is looked at, so copies on one spot do not multiply.
    """
    k = list(keys)
    near = nearest_site(right, left, k, "poi_id", "poi_id", max_m=radius_m, id_name="left_id", dist_name="_d")
    names = left.select(*k, F.col("poi_id").alias("left_id"), F.col("name").alias("_left_name"))
    judged = near.join(names, [*k, "left_id"], "left").withColumn(
        "_same", F.coalesce(F.col("left_id").isNotNull() & name_similar(F.col("_left_name"), F.col("name")), F.lit(False))
    )
    extra = judged.where("_same").select(*k, F.col("left_id").alias("poi_id"), F.explode("sources").alias("_s")).distinct()
    extra = extra.groupBy(*k, "poi_id").agg(F.collect_set("_s").alias("_more"))
    kept_left = left.join(extra, [*k, "poi_id"], "left").withColumn(
        "sources", F.array_sort(F.array_union("sources", F.coalesce("_more", F.array().cast("array<string>"))))
    ).drop("_more")
    kept_right = judged.where(~F.col("_same")).select(*left.columns)
    return kept_left.select(*left.columns).unionByName(kept_right)


def first_tier(rows: DataFrame, keys, tier: str = "tier") -> DataFrame:
    """Rows of the lowest tier present per key."""
    best = rows.groupBy(*keys).agg(F.min(tier).alias("_best"))
    return rows.join(best, list(keys)).where(F.col(tier) == F.col("_best")).drop("_best")


def best_per_key(rows: DataFrame, keys, order, n: int = 1, rank: str = "rank") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)
