"""Running totals and order statistics that never need one group in one task.

A window over a whole AOI would send that AOI to a single task.  Here values
are first collapsed to one row per (key, value), cut into fixed-width buckets,
and only bucket totals are prefix-summed per key; each bucket then adds its own
offset.  Distances are rounded to millimetres, so a bucket of ``width`` metres
holds at most 1000 * width rows however many points share a value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

BUCKET_M = 100.0
# ids or buckets per bucket of the next level
_FAN = 100_000.0


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    sums: Sequence[str],
    width: float = BUCKET_M,
    tie: Sequence[str] = (),
    levels: int = 1,
) -> DataFrame:
    """Add inclusive running totals ``cum_<s>`` ordered by ``value``.

    With ``levels`` above one the bucket totals are themselves summed in buckets
    of ``_FAN``, so values of any spread (64-bit ids) stay bounded per task.
    """
    k = list(keys)
    bucket = f"_b{levels}"
    b = df.withColumn(bucket, F.floor(F.col(value) / F.lit(float(width))))
    totals = b.groupBy(*k, bucket).agg(*[F.sum(s).alias(f"_t{levels}_{s}") for s in sums])
    names = [f"_t{levels}_{s}" for s in sums]
    if levels > 1:
        run = running_totals(totals, k, bucket, names, width=_FAN, levels=levels - 1)
        before = [(F.col(f"cum_{t}") - F.col(t)).alias(f"_o_{s}") for s, t in zip(sums, names)]
        offsets = run.select(*k, bucket, *before)
    else:
        w = Window.partitionBy(*k).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
        offsets = totals.select(
            *k, bucket, *[F.coalesce(F.sum(t).over(w), F.lit(0)).alias(f"_o_{s}") for s, t in zip(sums, names)]
        )
    inside = Window.partitionBy(*k, bucket).orderBy(value, *tie).rowsBetween(
        Window.unboundedPreceding, 0
    )
    out = b.join(offsets, [*k, bucket])
    for s in sums:
        out = out.withColumn(f"cum_{s}", F.sum(s).over(inside) + F.col(f"_o_{s}"))
    return out.drop(bucket, *[f"_o_{s}" for s in sums])


def id_ranks(df: DataFrame, keys: Sequence[str], ident: str, name: str) -> DataFrame:
    """Rank from 1 by a unique integer id per key, for ids of any spread."""
    one = df.withColumn("_one", F.lit(1).cast("bigint"))
    r = running_totals(one, keys, ident, ["_one"], width=_FAN, levels=4)
    return r.withColumnRenamed("cum__one", name).drop("_one")


def distance_histogram(
    df: DataFrame, keys: Sequence[str], dist: str = "dist_m", weight: str = "weight"
) -> DataFrame:
    """One row per (keys, distance): n points, weight w, weighted distance wd."""
    w = F.col(weight)
    return df.groupBy(*keys, F.col(dist).alias("d")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(w).alias("w"), F.sum(w * F.col(dist)).alias("wd")
    )


def distribution(df: DataFrame, keys: Sequence[str], dist: str = "dist_m", weight: str = "weight") -> DataFrame:
    """Histogram rows with running totals and the totals of their key."""
    k = list(keys)
    hist = distance_histogram(df, k, dist, weight)
    run = running_totals(hist, k, "d", ["n", "w", "wd"])
    tot = hist.groupBy(*k).agg(
        F.sum("n").alias("tot_n"), F.sum("w").alias("tot_w"), F.sum("wd").alias("tot_wd"),
        F.max("d").alias("max_d"), F.min("d").alias("min_d"),
    )
    return run.join(tot, k)


def gini_expr():
    """Weighted Gini over the rows of ``distribution`` (an aggregate)."""
    area = F.sum(F.col("w") * (F.lit(2.0) * F.col("cum_wd") - F.col("wd")))
    tw, twd, tn = F.max("tot_w"), F.max("tot_wd"), F.max("tot_n")
    g = F.lit(1.0) - area / (tw * twd)
    return F.when((tn < 2) | (tw <= 0) | (twd <= 0), F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), g))
    )


def percentile_expr(q: float):
    """Linear-interpolation percentile of the unweighted points (an aggregate)."""
    h = (F.col("tot_n") - 1) * F.lit(q)
    lo = F.min(F.when(F.col("cum_n") > F.floor(h), F.col("d")))
    hi = F.min(F.when(F.col("cum_n") > F.ceil(h), F.col("d")))
    hh = F.max(h)
    return lo + (hi - lo) * (hh - F.floor(hh))


def weighted_percentile_expr(q: float):
    """First distance whose cumulative weight reaches q of the total (an aggregate)."""
    reached = F.round(F.col("cum_w"), 6) >= F.round(F.lit(q) * F.col("tot_w"), 6)
    return F.min(F.when(reached, F.col("d")))


def worst_served(
    df: DataFrame,
    keys: Sequence[str],
    dist: str = "dist_m",
    weight: str = "weight",
    point_id: str = "demand_id",
    share: float = 0.10,
    dist_rows: DataFrame | None = None,
) -> DataFrame:
    """Weighted mean distance of the worst-served ``share`` of the weight per key.

    Points are taken from the largest distance down (ties by id) while their
    cumulative weight stays within the share; at least one point counts.
    """
    k = list(keys)
    rows = dist_rows if dist_rows is not None else distribution(df, k, dist, weight)
    limit = F.round(F.lit(share) * F.col("tot_w"), 6)
    from_top = F.round(F.col("tot_w") - F.col("cum_w") + F.col("w"), 6)
    whole = from_top <= limit
    summary = rows.groupBy(*k).agg(
        F.coalesce(F.sum(F.when(whole, F.col("w"))), F.lit(0.0)).alias("w0"),
        F.coalesce(F.sum(F.when(whole, F.col("wd"))), F.lit(0.0)).alias("wd0"),
        F.max(F.when(~whole, F.col("d"))).alias("edge_d"),
        F.max(limit).alias("lim"),
        F.max("max_d").alias("max_d"),
    )
    edge = (
        df.select(*k, F.col(point_id).alias("pid"), F.col(dist).alias("d"), F.col(weight).alias("w"))
        .join(summary.select(*k, F.col("edge_d").alias("d"), "w0", "lim"), [*k, "d"])
    )
    part = (
        running_totals(edge, [*k, "d"], "pid", ["w"], width=_FAN, levels=4)
        .where(F.round(F.col("cum_w") + F.col("w0"), 6) <= F.col("lim"))
        .groupBy(*k)
        .agg(F.sum("w").alias("w1"), F.sum(F.col("w") * F.col("d")).alias("wd1"))
    )
    tw = F.col("w0") + F.coalesce("w1", F.lit(0.0))
    twd = F.col("wd0") + F.coalesce("wd1", F.lit(0.0))
    return summary.join(part, k, "left").select(
        *k, F.when(tw > 0, twd / tw).otherwise(F.col("max_d")).alias("bottom_decile_m")
    )
