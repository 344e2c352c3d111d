"""Shared pieces of the location models.

Every model is keyed: one run can hold many areas and scenarios, and a round
advances all keys at once.  Per round only counters come back to the driver.
Ties break on the lowest site id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import geo
from ..operators.coverage import pairs_within
from ..session import materialize

# sums of doubles differ in the last bits between runs; comparing rounded gains
# keeps ties ties
GAIN_DIGITS = 4
COST_DIGITS = 0


def demand_spots(demand: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Demand collapsed to one row per place: copies on a spot act as one weight."""
    return demand.groupBy(*keys, "lon", "lat").agg(
        F.min("demand_id").alias("demand_id"), F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n_points")
    )


def coverage(demand: DataFrame, sites: DataFrame, radius_m: float, keys: Sequence[str]) -> DataFrame:
    """(keys, demand_id, site_id, weight) of the covered pairs of demand spots."""
    d = demand.select(*keys, "demand_id", "lon", "lat", "weight")
    extra = [c for c in ("reliability", "cost") if c in sites.columns]
    s = sites.select(*keys, "site_id", "lon", "lat", *extra)
    return pairs_within(d, s, radius_m, keys).select(*keys, "demand_id", "site_id", "weight", *extra)


def best_site(gains: DataFrame, keys: Sequence[str], score: str = "gain", extra: Sequence[str] = ()) -> DataFrame:
    """Highest score per key, lowest site id among equals; a plain aggregate."""
    s = F.struct(F.col(score).alias("s"), (-F.col("site_id")).alias("i"), *extra)
    return gains.groupBy(*keys).agg(F.max(s).alias("m")).select(
        *keys, (-F.col("m.i")).alias("site_id"), F.col("m.s").alias(score), *[F.col(f"m.{e}").alias(e) for e in extra]
    )


def assign_nearest(demand: DataFrame, selected: DataFrame, keys: Sequence[str], metric=geo.Haversine) -> DataFrame:
    """Each demand row with its nearest selected site (J7 over the solution)."""
    from ..operators.nearest import nearest_site

    return nearest_site(demand, selected, keys, metric=metric)


def with_dist(demand: DataFrame, picked: DataFrame, keys: Sequence[str], name: str = "_d", metric=geo.Haversine) -> DataFrame:
    """Demand joined with one (or few) picked sites per key: a narrow lookup by key."""
    p = picked.select(*keys, "site_id", F.col("lon").alias("_sx"), F.col("lat").alias("_sy"))
    d = metric.dist(F.col("lon"), F.col("lat"), F.col("_sx"), F.col("_sy"))
    return demand.join(p, list(keys), "left").withColumn(name, d).drop("_sx", "_sy")


def sorted_in(df: DataFrame) -> DataFrame:
    """``df`` for a join by demand or site: as many rows as those, which files of few bytes may hold, so neither side is broadcast."""
    return df.hint("merge")


def rounded(c: Column) -> Column:
    return F.round(c, GAIN_DIGITS)


def table(df: DataFrame, label: str) -> DataFrame:
    return materialize(df, label)


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """``df`` by hash over two tasks a core: few rows that cost much work each would else share one task."""
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism, *cols)
