"""Nearest-site join and range join against brute force, with skew and copies."""

import math
import random

import pytest
from pyspark.sql import functions as F

from catchment.functions import geo
from catchment.operators import coverage
from catchment.operators.nearest import SiteTree, nearest_site

R = 6371008.8


def hav(a, b):
    p1, p2 = math.radians(a[1]), math.radians(b[1])
    h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * R * math.asin(min(1.0, math.sqrt(h)))


def world(spark, n_pts, n_sites, seed, spread=None):
    rnd = random.Random(seed)
    lon = lambda: rnd.uniform(-180, 180)
    lat = lambda: rnd.uniform(-90, 90)
    if spread:
        lon = lambda: 10 + rnd.uniform(0, spread)
        lat = lambda: 50 + rnd.uniform(0, spread)
    pts = [("A", i, lon(), lat(), 1.0) for i in range(n_pts)]
    # a third of the sites on one spot, a third in one tiny cluster
    sites = []
    for i in range(n_sites):
        if i % 3 == 0:
            sites.append(("A", i, 10.25, 50.25))
        elif i % 3 == 1:
            sites.append(("A", i, 10.5 + rnd.uniform(0, 1e-5), 50.5 + rnd.uniform(0, 1e-5)))
        else:
            sites.append(("A", i, lon(), lat()))
    d = spark.createDataFrame(pts, "aoi_id string, demand_id bigint, lon double, lat double, weight double")
    s = spark.createDataFrame(sites, "aoi_id string, site_id bigint, lon double, lat double")
    return pts, sites, d, s


@pytest.mark.parametrize("spread", [None, 1.0])
def test_nearest_equals_brute_force(spark, spread):
    pts, sites, d, s = world(spark, 300, 240, 5, spread)
    tree = SiteTree(s, ["aoi_id"], leaf=4)
    assert tree.depth >= 2
    got = {r.demand_id: (r.dist_m, r.site_id) for r in nearest_site(d, tree).collect()}
    assert len(got) == len(pts)
    for p in pts:
        best = min(hav(p[2:4], q[2:4]) for q in sites)
        dist, site = got[p[1]]
        assert abs(dist - best) < 0.01
        near = [q[1] for q in sites if round(hav(p[2:4], q[2:4]), 3) == dist]
        if near:
            assert site == min(near)


def test_nearest_across_the_date_line(spark):
    d = spark.createDataFrame([("A", 1, 179.9, 10.0)], "aoi_id string, demand_id bigint, lon double, lat double")
    s = spark.createDataFrame([("A", 1, -179.9, 10.0), ("A", 2, 170.0, 10.0)], "aoi_id string, site_id bigint, lon double, lat double")
    assert nearest_site(d, s).first().site_id == 1


def test_nearest_limit_and_missing_key(spark):
    d = spark.createDataFrame([("A", 1, 0.0, 0.0), ("B", 2, 0.0, 0.0), ("A", 3, 5.0, 0.0)], "aoi_id string, demand_id bigint, lon double, lat double")
    s = spark.createDataFrame([("A", 9, 0.001, 0.0)], "aoi_id string, site_id bigint, lon double, lat double")
    got = {r.demand_id: r.site_id for r in nearest_site(d, s, max_m=1000.0).collect()}
    assert got == {1: 9, 2: None, 3: None}


@pytest.mark.parametrize("metric", [geo.Planar, geo.Manhattan])
def test_planar_metrics(spark, metric):
    rnd = random.Random(3)
    pts = [("A", i, rnd.uniform(0, 1000), rnd.uniform(0, 1000)) for i in range(150)]
    sites = [("A", i, rnd.uniform(0, 1000), rnd.uniform(0, 1000)) for i in range(120)]
    d = spark.createDataFrame(pts, "aoi_id string, demand_id bigint, lon double, lat double")
    s = spark.createDataFrame(sites, "aoi_id string, site_id bigint, lon double, lat double")
    got = {r.demand_id: r.dist_m for r in nearest_site(d, SiteTree(s, ["aoi_id"], leaf=4, metric=metric)).collect()}
    f = (lambda a, b: math.dist(a, b)) if metric is geo.Planar else (lambda a, b: abs(a[0] - b[0]) + abs(a[1] - b[1]))
    for p in pts:
        assert abs(got[p[1]] - min(f(p[2:], q[2:]) for q in sites)) < 0.002


@pytest.mark.parametrize("hot", [10, 200_000])
def test_pairs_within_equals_brute_force(spark, hot):
    rnd = random.Random(8)
    pts = [("A", i, rnd.choice([179.95, -179.95, 20.0]) + rnd.uniform(-0.04, 0.04), rnd.choice([0.0, 60.0, 89.95]) + rnd.uniform(-0.04, 0.04)) for i in range(200)]
    sites = [("A", i, rnd.choice([179.95, -179.95, 20.0]) + rnd.uniform(-0.04, 0.04), rnd.choice([0.0, 60.0, 89.95]) + rnd.uniform(-0.04, 0.04)) for i in range(80)]
    d = spark.createDataFrame(pts, "aoi_id string, demand_id bigint, lon double, lat double")
    s = spark.createDataFrame(sites, "aoi_id string, site_id bigint, lon double, lat double")
    got = [(r.demand_id, r.site_id) for r in coverage.pairs_within(d, s, 5000.0, hot_cell=hot).collect()]
    assert len(got) == len(set(got))
    want = {(p[1], q[1]) for p in pts for q in sites if hav(p[2:], q[2:]) <= 5000.0}
    assert set(got) == want


def test_result_does_not_depend_on_row_order(spark):
    _, _, d, s = world(spark, 120, 90, 4, 1.0)
    a = sorted(map(tuple, nearest_site(d, s).collect()))
    b = sorted(map(tuple, nearest_site(d.repartition(7).orderBy(F.rand(1)), s.repartition(5)).collect()))
    assert a == b


def test_no_cartesian_plan(spark):
    _, _, d, s = world(spark, 50, 30, 4, 1.0)
    plan = coverage.pairs_within(d, s, 5000.0)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_geodesic_degree_at_equator(spark):
    df = spark.createDataFrame([(0.0, 0.0, 1.0, 0.0)], "a double, b double, c double, d double")
    v = df.select(geo.geodesic_m(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).first()[0]
    assert abs(v - 111319.491) < 0.01


def test_geodesic_pairs_close_to_sphere(spark):
    _, _, d, s = world(spark, 60, 60, 2, 0.2)
    g = {(r.demand_id, r.site_id): r.dist_m for r in coverage.geodesic_pairs(d, s, 9000.0).collect()}
    h = {(r.demand_id, r.site_id): r.dist_m for r in coverage.coverage_pairs(d, s, 9500.0).collect()}
    assert g and all(abs(v / h[k] - 1) < 0.007 for k, v in g.items() if v > 1)
