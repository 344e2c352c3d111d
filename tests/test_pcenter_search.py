"""Radius search of p-center, plain, weighted and beside existing sites, against enumeration."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from catchment.functions import geo
from catchment.location import pcenter
from catchment.operators.coverage import pairs_within_own

K = ["aoi_id"]


def area(spark, seed, n, m):
    rnd = random.Random(seed)
    dem = [("A", i, rnd.uniform(0, 9000), rnd.uniform(0, 9000), float(rnd.choice([0, 1, 1, 2, 5, 40]))) for i in range(n)]
    dem += [("A", n + i, *dem[i][2:4], 3.0) for i in range(5)]  # copies on a spot, other weights
    sit = [("A", i, rnd.uniform(0, 9000), rnd.uniform(0, 9000)) for i in range(m)]
    d = spark.createDataFrame(dem, "aoi_id string, demand_id bigint, lon double, lat double, weight double")
    s = spark.createDataFrame(sit, "aoi_id string, site_id bigint, lon double, lat double")
    return d, s, dem, sit


def worst(dem, sites, weighted):
    def dist(a, b):
        return ((a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2) ** 0.5

    return max((d[4] if weighted else 1.0) * min(dist(d, s) for s in sites) for d in dem)


@pytest.mark.parametrize("weighted,given", [(False, 0), (True, 0), (False, 2), (True, 2)])
def test_search_against_enumeration(spark, weighted, given):
    d, s, dem, sit = area(spark, 5 + given, 40, 11)
    have = sit[:given]
    existing = s.where(F.col("site_id") < given) if given else None
    got = pcenter.p_center(d, s, 3, weighted=weighted, existing=existing, metric=geo.Planar).first()
    best = min(worst(dem, [*c, *have], weighted) for c in itertools.combinations(sit[given:], 3))
    ids = [int(x) for x in got.site_ids.split(",")]
    assert len(set(ids)) <= 3 and all(i >= given for i in ids)
    real = worst(dem, [*[sit[i] for i in ids], *have], weighted)
    assert got.objective == pytest.approx(real, abs=0.05)
    assert got.lower_bound <= best + 0.05
    assert best - 0.05 <= got.objective <= best * 1.25


def test_forced_sites_against_enumeration(spark):
    """Area A: one site forced, one shut, one both (so open); B: as many forced as p; C: none forced."""
    d, s, dem, sit = area(spark, 9, 30, 9)
    name = lambda df, a: df.withColumn("aoi_id", F.lit(a))
    d3, s3 = (name(x, "A").unionByName(name(x, "B")).unionByName(name(x, "C")) for x in (d, s))
    ids = "aoi_id string, site_id bigint"
    opened = spark.createDataFrame([("A", 2), ("A", 5), ("B", 0), ("B", 1), ("B", 3)], ids)
    shut = spark.createDataFrame([("A", 5), ("A", 7), ("B", 8), ("C", 0)], ids)
    rows = {r.aoi_id: r for r in pcenter.p_center(d3, s3, 3, metric=geo.Planar, must_open=opened, must_close=shut).collect()}
    force, close = {"A": {2, 5}, "B": {0, 1, 3}, "C": set()}, {"A": {7}, "B": {8}, "C": {0}}
    assert sorted(rows) == ["A", "B", "C"]
    for a, r in rows.items():
        got = {int(x) for x in r.site_ids.split(",")}
        assert force[a] <= got and not got & close[a] and len(got) <= 3
        sets = [c for c in itertools.combinations([x for x in sit if x[1] not in close[a]], 3) if force[a] <= {x[1] for x in c}]
        best = min(worst(dem, c, False) for c in sets)
        assert r.objective == pytest.approx(worst(dem, [sit[i] for i in got], False), abs=0.05)
        assert r.lower_bound <= best + 0.05 and best - 0.05 <= r.objective <= best * 1.25


def test_own_reach_of_every_row(spark):
    rnd = random.Random(2)
    dem = [("A", i, 10 + rnd.uniform(0, 2), 50 + rnd.uniform(0, 2), rnd.choice([0.0, 0.5, 700.0, 9000.0, 150000.0])) for i in range(80)]
    sit = [("A", i, 10 + rnd.uniform(0, 2), 50 + rnd.uniform(0, 2)) for i in range(60)] + [("A", 99, dem[0][2], dem[0][3])]
    d = spark.createDataFrame(dem, "aoi_id string, demand_id bigint, lon double, lat double, reach double")
    s = spark.createDataFrame(sit, "aoi_id string, site_id bigint, lon double, lat double")
    got = pairs_within_own(d, s, "reach").select("demand_id", "site_id")
    every = d.join(s.withColumnsRenamed({"lon": "sx", "lat": "sy"}), "aoi_id").withColumn(
        "m", geo.Haversine.dist(F.col("lon"), F.col("lat"), F.col("sx"), F.col("sy"))
    ).where("reach > 0 and m <= reach").select("demand_id", "site_id")
    assert sorted(got.collect()) == sorted(every.collect())
    assert pairs_within_own(d.where("reach = 0"), s, "reach").count() == 0
