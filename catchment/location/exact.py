"""Optimum over all site subsets, for small instances and as a yardstick in tests."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions import geo

MAX_SUBSETS = 200_000


def exact_p_median(demand: DataFrame, candidates: DataFrame, p: int, keys: Sequence[str] = ("aoi_id",), metric=geo.Haversine, goal: str = "median") -> DataFrame:
    """(keys, site_ids, cost) of the best subset of p sites.

    The number of subsets grows beyond any cluster, so larger instances are
    refused; use the greedy and swap models there.  ``goal`` is median (total
    weighted distance) or center (longest distance).
    """
    k = list(keys)
    n = candidates.groupBy(*k).count().agg(F.max("count")).first()[0] or 0
    if math.comb(n, min(p, n)) > MAX_SUBSETS:
        raise ValueError(f"{n} sites give more than {MAX_SUBSETS} subsets of {p}")
    c = candidates.select(*k, "site_id", "lon", "lat")
    sets = c.select(*k, F.array("site_id").alias("ids"), F.array(F.struct("lon", "lat")).alias("xy"))
    for _ in range(p - 1):
        nxt = c.select(*k, F.col("site_id").alias("_s"), F.struct("lon", "lat").alias("_p"))
        sets = sets.join(nxt, k).where(F.col("_s") > F.element_at("ids", -1)).select(
            *k, F.concat("ids", F.array("_s")).alias("ids"), F.concat("xy", F.array("_p")).alias("xy")
        )
    d = demand.select(*k, "lon", "lat", "weight").join(sets, k)
    near = F.array_min(F.transform("xy", lambda q: metric.dist(F.col("lon"), F.col("lat"), q["lon"], q["lat"])))
    score = F.sum(F.col("weight") * near) if goal == "median" else F.max(near)
    out = d.groupBy(*k, "ids").agg(score.alias("cost"))
    best = out.groupBy(*k).agg(F.min(F.struct("cost", "ids")).alias("m"))
    return best.select(*k, F.col("m.ids").alias("site_ids"), F.col("m.cost").alias("cost"))
