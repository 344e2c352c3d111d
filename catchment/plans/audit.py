"""Audit of existing sites: coverage, access, equity, density, worst points."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import measures, network, running
from ..operators.nearest import nearest_site
from ..session import materialize


def analyze_facilities(
    demand: DataFrame,
    sites: DataFrame,
    radius_m: float,
    edges: DataFrame | None = None,
    keys=("aoi_id",),
    top_n_worst: int = 10,
    nearest: DataFrame | None = None,
) -> DataFrame:
    """One row per AOI that has demand with the full audit; without a site nothing is covered and distances are null."""
    if radius_m is None or radius_m <= 0:
        raise ValueError("radius_m must be > 0")
    if nearest is None:
        if demand.isEmpty():
            raise ValueError("demand is empty")
        if sites.isEmpty():
            raise ValueError("sites are empty")
        nearest = nearest_site(demand, sites, keys).where(F.col("dist_m").isNotNull())
        nearest = materialize(nearest.select(*keys, "demand_id", "lon", "lat", "weight", "site_id", "dist_m"), "nearest")
    k = list(keys)
    # read three times below
    rows = materialize(running.distribution(nearest, k), "distances")
    covered = F.col("d") <= radius_m
    cov_w = F.coalesce(F.sum(F.when(covered, F.col("w"))), F.lit(0.0))
    tw = F.max("tot_w")
    base = rows.groupBy(*k).agg(
        F.max("tot_n").alias("n_demand"),
        F.round(measures.pct(cov_w, tw), 6).alias("pct_weight_covered"),
        F.round(
            F.coalesce(F.sum(F.when(covered, F.col("n"))), F.lit(0)) / F.max("tot_n") * 100.0, 6
        ).alias("pct_points_covered"),
        F.round(F.greatest(F.lit(0.0), tw - cov_w), 4).alias("uncovered_weight"),
        F.round(
            F.when(tw > 0, F.max("tot_wd") / tw).otherwise(F.sum(F.col("n") * F.col("d")) / F.max("tot_n")), 3
        ).alias("avg_distance_m"),
        F.max("max_d").alias("max_distance_m"),
        F.round(running.percentile_expr(0.9), 3).alias("p90_distance_m"),
        F.round(running.gini_expr(), 6).alias("gini"),
        tw.alias("tot_w"),
    )
    decile = running.worst_served(nearest, k, dist_rows=rows)
    worst = (
        measures.top_n(nearest, k, [F.desc("dist_m"), F.asc("demand_id")], top_n_worst)
        .groupBy(*k)
        .agg(F.array_sort(F.collect_list(F.struct("rank", "demand_id"))).alias("wl"))
        .select(*k, F.array_join(F.transform("wl", lambda s: s["demand_id"].cast("string")), ",").alias("worst_points"))
    )
    n_sites = sites.groupBy(*k).agg(F.count(F.lit(1)).alias("n_facilities"))
    every = demand.groupBy(*k).agg(F.count(F.lit(1)).alias("_n"), F.sum("weight").alias("_w"))
    out = every.join(base, k, "left").join(decile, k, "left").join(worst, k, "left").join(n_sites, k, "left")
    zero = {c: F.coalesce(c, F.lit(0.0)) for c in ("pct_weight_covered", "pct_points_covered")}
    out = out.withColumns(zero | {
        "n_facilities": F.coalesce("n_facilities", F.lit(0)), "n_demand": F.coalesce("n_demand", "_n"),
        "uncovered_weight": F.coalesce("uncovered_weight", F.round("_w", 4)), "tot_w": F.coalesce("tot_w", "_w"),
    })
    per_km2 = F.lit(None).cast("double")
    if edges is not None:
        out = out.join(measures.polygon_area(edges, k), k, "left")
        per_km2 = F.when(F.col("area_km2") > 0, F.col("n_facilities") / F.col("area_km2")).otherwise(F.lit(0.0))
    return out.select(
        *k, "n_demand", "n_facilities", "pct_weight_covered", "pct_points_covered", "uncovered_weight",
        "avg_distance_m", "max_distance_m", "p90_distance_m", "gini",
        F.round("bottom_decile_m", 3).alias("bottom_decile_m"),
        F.round(per_km2, 9).alias("facilities_per_km2"),
        F.round(F.when(F.col("tot_w") > 0, F.col("n_facilities") / F.col("tot_w") * 1000.0).otherwise(F.lit(0.0)), 9).alias("facilities_per_1000"),
        "worst_points",
    )


def nearest_by_road(
    demand: DataFrame, sites: DataFrame, nodes: DataFrame, roads: DataFrame, cutoff_m: float | None = None, keys=("aoi_id",), direction: str = "from_site"
) -> DataFrame:
    """Every demand row of a key with sites, with its nearest site by road: (keys, demand_id, lon, lat, weight, site_id, dist_m, on_road).

    Both ends are snapped to junctions.  All sites spread over the roads at once, so there is
    one label a junction.  Demand that no site reaches within the cutoff gets the nearest
    site in a straight line, with ``on_road`` false.
    """
    k = list(keys)
    d = network.snapped(demand.select(*k, "demand_id", "lon", "lat", "weight"), nodes, k, "demand_id", "node")
    s = network.snapped(sites.select(*k, "site_id", "lon", "lat"), nodes, k, "site_id", "node_id")
    labels = network.nearest_sources(roads, s.where("node_id is not null").select(*k, "node_id", F.col("site_id").alias("source")), k, cutoff_m, direction, nodes)
    d = materialize(d.join(labels.withColumnsRenamed({"source": "site_id"}), [*k, "node"], "left").drop("node"), "by_road")
    on = d.where("dist_m is not null").withColumn("on_road", F.lit(True))
    off = nearest_site(d.where("dist_m is null").drop("site_id", "dist_m"), sites, k).where("dist_m is not null").withColumn("on_road", F.lit(False))
    cols = [*k, "demand_id", "lon", "lat", "weight", "site_id", "dist_m", "on_road"]
    return on.select(cols).unionByName(off.select(cols))


def analyze_facilities_network(
    demand: DataFrame,
    sites: DataFrame,
    radius_m: float,
    nodes: DataFrame,
    roads: DataFrame,
    edges: DataFrame | None = None,
    keys=("aoi_id",),
    top_n_worst: int = 10,
    direction: str = "from_site",
) -> DataFrame:
    """The audit by road distance, searched as far as five radii or 5 km, with ``n_off_road``: demand that fell back to a straight line.

    A site beyond that reach never counts in place of one that is reached, however near it
    lies in a straight line.  Without roads all distances are straight lines.
    """
    if radius_m is None or radius_m <= 0:
        raise ValueError("radius_m must be > 0")
    if demand.isEmpty():
        raise ValueError("demand is empty")
    if sites.isEmpty():
        raise ValueError("sites are empty")
    k = list(keys)
    near = materialize(nearest_by_road(demand, sites, nodes, roads, max(5.0 * radius_m, 5000.0), k, direction), "nearest")
    report = analyze_facilities(demand, sites, radius_m, edges, k, top_n_worst, near.drop("on_road"))
    off = near.groupBy(*k).agg(F.count(F.when(~F.col("on_road"), 1)).alias("n_off_road"))
    return report.join(off, k, "left").withColumn("n_off_road", F.coalesce("n_off_road", F.lit(0).cast("bigint")))
