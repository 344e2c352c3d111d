"""Coverage, access and equity measures over per-point distances."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import geo
from . import running


def pct(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den * 100.0).otherwise(F.lit(0.0))


def coverage_summary(df: DataFrame, radius_m: float, keys=("aoi_id",)) -> DataFrame:
    w, hit = F.col("weight"), F.col("dist_m") <= radius_m
    cov = F.coalesce(F.sum(F.when(hit, w)), F.lit(0.0))
    return df.groupBy(*keys).agg(
        F.round(pct(cov, F.sum(w)), 6).alias("pct_weight_covered"),
        F.round(F.avg(F.when(hit, 100.0).otherwise(0.0)), 6).alias("pct_points_covered"),
        F.round(F.greatest(F.lit(0.0), F.sum(w) - cov), 4).alias("uncovered_weight"),
    )


def weighted_mean(v: Column, w: Column) -> Column:
    return F.when(F.sum(w) > 0, F.sum(w * v) / F.sum(w)).otherwise(F.avg(v))


def access_summary(df: DataFrame, keys=("aoi_id",)) -> DataFrame:
    rows = running.distribution(df, keys)
    return rows.groupBy(*keys).agg(
        F.round(
            F.when(F.max("tot_w") > 0, F.max("tot_wd") / F.max("tot_w")).otherwise(
                F.sum(F.col("n") * F.col("d")) / F.max("tot_n")
            ), 3,
        ).alias("avg_distance_m"),
        F.max("max_d").alias("max_distance_m"),
        F.round(running.percentile_expr(0.9), 3).alias("p90_distance_m"),
    )


def distance_distribution(df: DataFrame, keys=("aoi_id",)) -> DataFrame:
    """Weighted distance distribution in kilometres, three decimals."""
    rows = running.distribution(df, keys)
    mean = F.sum(F.col("n") * F.col("d")) / F.max("tot_n")
    var = F.sum(F.col("n") * F.col("d") * F.col("d")) / F.max("tot_n") - mean * mean

    def km(c: Column) -> Column:
        return F.round(c / 1000.0, 3)

    return rows.groupBy(*keys).agg(
        km(F.max("tot_wd") / F.max("tot_w")).alias("mean_km"),
        km(running.weighted_percentile_expr(0.5)).alias("median_km"),
        km(running.weighted_percentile_expr(0.9)).alias("p90_km"),
        km(running.weighted_percentile_expr(0.95)).alias("p95_km"),
        km(F.max("max_d")).alias("max_km"),
        km(F.min("min_d")).alias("min_km"),
        km(F.sqrt(F.greatest(F.lit(0.0), var))).alias("std_km"),
    )


def gini(df: DataFrame, keys=("aoi_id",)) -> DataFrame:
    rows = running.distribution(df, keys)
    return rows.groupBy(*keys).agg(F.round(running.gini_expr(), 6).alias("gini"))


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """First n rows per key; Spark trims each partition before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def polygon_area(edges: DataFrame, keys=("aoi_id",)) -> DataFrame:
    """Ring area in km2 on the equal-area projection."""
    x1, y1 = geo.equal_area(F.col("x1"), F.col("y1"))
    x2, y2 = geo.equal_area(F.col("x2"), F.col("y2"))
    return edges.groupBy(*keys).agg((F.abs(F.sum(x1 * y2 - x2 * y1)) / 2.0 / 1e6).alias("area_km2"))


def polygon_centroid(edges: DataFrame, keys=("aoi_id",)) -> DataFrame:
    """Area centroid in lon/lat; coordinates are taken relative to the box corner."""
    box = edges.groupBy(*keys).agg(F.min("x1").alias("bx"), F.min("y1").alias("by"))
    e = edges.join(box, list(keys))
    x1, y1 = F.col("x1") - F.col("bx"), F.col("y1") - F.col("by")
    x2, y2 = F.col("x2") - F.col("bx"), F.col("y2") - F.col("by")
    cr = x1 * y2 - x2 * y1
    return e.groupBy(*keys).agg(
        (F.max("bx") + F.sum((x1 + x2) * cr) / (F.lit(3.0) * F.sum(cr))).alias("lon"),
        (F.max("by") + F.sum((y1 + y2) * cr) / (F.lit(3.0) * F.sum(cr))).alias("lat"),
        (F.sum(cr) / 2.0).alias("area_deg2"),
    )
