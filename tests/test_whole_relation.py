"""Relations that used to be written pair by pair: capacity in covering, roads."""

import random

import pytest
from pyspark.sql import functions as F

from catchment.location import cover
from catchment.operators import coverage, network

D = "aoi_id string, demand_id bigint, lon double, lat double, weight double"


def _points(n, seed):
    r = random.Random(seed)
    return [("a", i, 10 + r.random() * 0.4, 45 + r.random() * 0.3, 1.0 + r.randrange(50)) for i in range(n)]


@pytest.mark.parametrize("at_once", [5_000_000, 700])
def test_capacity_serves_the_closest_without_all_pairs(spark, monkeypatch, at_once):
    monkeypatch.setattr(cover, "PAIRS_AT_ONCE", at_once)
    seen, store = [], cover.table
    monkeypatch.setattr(cover, "table", lambda df, label: seen.append(store(df, label)) or seen[-1])
    monkeypatch.setattr(cover, "release", lambda *t: None)
    demand, r = _points(400, 1), random.Random(3)
    # some hold all they reach, some fill up
    sites = [p[:4] + (float(r.choice([150, 600, 5000])),) for p in _points(60, 2)]
    d, s = spark.createDataFrame(demand, D), spark.createDataFrame(sites, "aoi_id string, site_id bigint, lon double, lat double, capacity double")
    near = [tuple(x) for x in coverage.pairs_within(d, s, 9000.0).select("site_id", "dist_m", "demand_id", "weight", "capacity").collect()]
    got = {(g.step, g.site_id, g.demand_id) for g in cover.greedy_capacity(d, s, 9000.0, 4).collect()}
    left, shut, want = {p[1] for p in demand}, set(), set()
    for step in range(1, 5):
        held = {}
        for site, _, dem, w, c in sorted(near):
            if dem in left and site not in shut:
                used, ids, full = held.get(site, (0.0, [], False))
                held[site] = (used, ids, True) if full or used + w > c else (used + w, [*ids, dem], False)
        best = min(held, key=lambda i: (-held[i][0], i))
        want |= {(step, best, x) for x in held[best][1]}
        left -= set(held[best][1])
        shut.add(best)
    assert got == want
    assert max(t.count() for t in seen) < len(near)


@pytest.fixture(scope="module")
def roads(spark):
    r = random.Random(7)
    nodes = [("a", i * 10 + j, 10 + i * 0.04, 45 + j * 0.03) for i in range(10) for j in range(10)]
    edges = [("a", n, m, 2500.0 + r.randrange(900)) for _, n, _, _ in nodes for m in (n + 1, n + 10, n - 1, n - 10) if 0 <= m < 100 and (n // 10 == m // 10 or n % 10 == m % 10) and r.random() > 0.2]
    demand = _points(500, 5) + [("b", 1, 10.0, 45.0, 1.0)]
    sites = [p[:4] for p in _points(50, 6)] + [("b", 1, 10.0, 45.001)]
    return (spark.createDataFrame(demand, D), spark.createDataFrame(sites, "aoi_id string, site_id bigint, lon double, lat double"),
            spark.createDataFrame(nodes, "aoi_id string, node_id bigint, lon double, lat double"), spark.createDataFrame(edges, "aoi_id string, src bigint, dst bigint, length_m double"))


def _plain(roads, radius):
    """All pairs within the radius with the road between their junctions."""
    d, s, n, e = roads
    ds = network.snapped(d, n, ["aoi_id"], "demand_id", "d_node")
    ss = network.snapped(s, n, ["aoi_id"], "site_id", "s_node")
    paths = network.shortest_paths(e, n, ["aoi_id"]).select("aoi_id", F.col("source").alias("s_node"), F.col("node").alias("d_node"), F.col("dist_m").alias("road_m"))
    near = coverage.pairs_within(ds, ss, radius)
    return near.join(paths, ["aoi_id", "s_node", "d_node"], "left").select("aoi_id", "demand_id", "site_id", "weight", "dist_m", "road_m")


def test_road_pairs_are_made_last(roads, monkeypatch):
    seen, store = [], network.materialize
    monkeypatch.setattr(network, "materialize", lambda df, label: seen.append(label) or store(df, label))
    got = {tuple(r) for r in network.network_pairs(*roads, 9000.0).collect()}
    want = {(r.aoi_id, r.demand_id, r.site_id, r.dist_m if r.road_m is None else r.road_m, r.road_m is not None) for r in _plain(roads, 9000.0).collect()}
    assert got == want and ("b", 1, 1) in {r[:3] for r in got}
    assert "pairs" not in seen and "near" in seen


@pytest.mark.parametrize("radius", [9000.0, 30000.0])
def test_cover_by_road_keeps_every_gain(roads, radius):
    got = network.covered_by_road(*roads, radius, 11000.0).cache()
    want = _plain(roads, radius).where("road_m <= 11000").cache()
    gain = lambda t: {(r.site_id, r.w) for r in t.groupBy("site_id").agg(F.sum("weight").alias("w")).collect()}
    assert gain(got) == gain(want)
    assert got.count() < want.count()
