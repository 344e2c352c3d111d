"""Paths over roads cut into blocks, against Dijkstra's rule on plain lists."""

import random

import pytest

from catchment.operators import network
from catchment.plans import audit

from test_other import EDGE, dijkstra

NODE = "aoi_id string, node_id bigint, lon double, lat double"


def _roads(seed, n, roads, key="A"):
    r = random.Random(seed)
    at = [(key, i, r.random(), r.random()) for i in range(n)]
    edges = [(r.randrange(n), r.randrange(n), float(r.randint(1, 400))) for _ in range(roads)]
    return at, edges


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(network, "BLOCK_EDGES", 90)
    monkeypatch.setattr(network, "SOURCES", 2)


@pytest.mark.parametrize("with_places, step", [(True, 400.0), (False, None)])
def test_blocks_settle_what_dijkstra_settles(spark, small_blocks, with_places, step):
    at, edges = _roads(1, 70, 180)
    df = spark.createDataFrame([("A", *e) for e in edges] + [("B", 0, 1, 5.0), ("A", 3, None, 1.0), ("A", 3, 4, None)], EDGE)
    nodes = spark.createDataFrame(at, NODE) if with_places else None
    sources = [0, 7, 33, 69]
    src = spark.createDataFrame([("A", s) for s in sources] + [("A", 500), ("B", 0)], "aoi_id string, node_id bigint")
    want = {("A", s, n): d for s in sources for n, d in dijkstra(edges, s).items()} | {("A", 500, 500): 0.0, ("B", 0, 0): 0.0, ("B", 0, 1): 5.0}
    got = network.shortest_paths(df, src, nodes=nodes, step_m=step).collect()
    assert {(r.aoi_id, r.source, r.node): r.dist_m for r in got} == want and len(got) == len(want)
    cut = network.shortest_paths(df, src, cutoff_m=350.0, nodes=nodes, step_m=step).collect()
    assert {(r.aoi_id, r.source, r.node): r.dist_m for r in cut} == {k: v for k, v in want.items() if v <= 350.0}
    wanted = [(0, 5), (0, 60), (7, 7), (69, 2), (69, 1000)]
    targets = spark.createDataFrame([("A", *w) for w in wanted], "aoi_id string, source bigint, node bigint")
    some = network.shortest_paths(df, src, targets=targets, nodes=nodes, step_m=step).collect()
    assert {(r.source, r.node): r.dist_m for r in some} == {w: want[("A", *w)] for w in wanted if ("A", *w) in want}


def test_one_label_a_junction(spark, small_blocks):
    at, edges = _roads(2, 80, 200)
    df, nodes = spark.createDataFrame([("A", *e) for e in edges], EDGE), spark.createDataFrame(at, NODE)
    starts = {3: 9, 40: 2, 41: 30, 79: 5}  # node -> source
    src = spark.createDataFrame([("A", n, s) for n, s in starts.items()] + [("A", 3, 20)], "aoi_id string, node_id bigint, source bigint")
    for direction, flip in (("from_site", False), ("to_site", True)):
        way = [(b, a, w) for a, b, w in edges] if flip else edges
        far = {s: dijkstra(way, n) for n, s in starts.items()}
        want = {n: min((d[n], s) for s, d in far.items() if n in d) for n in range(80) if any(n in d for d in far.values())}
        got = network.nearest_sources(df, src, direction=direction, nodes=nodes).collect()
        assert {r.node: (r.dist_m, r.source) for r in got} == want and len(got) == len(want)
        near = network.nearest_sources(df, src, cutoff_m=200.0, direction=direction, nodes=nodes, step_m=None).collect()
        assert {r.node: (r.dist_m, r.source) for r in near} == {n: v for n, v in want.items() if v[0] <= 200.0}
    assert network.nearest_sources(df, src.where("false"), nodes=nodes).count() == 0


def test_a_junction_with_very_many_roads(spark):
    spokes = spark.range(1, 30_001).selectExpr("'A' as aoi_id", "id", "cast(1 + id % 7 as double) as length_m")
    roads = spokes.selectExpr("aoi_id", "0L as src", "id as dst", "length_m").unionByName(spokes.selectExpr("aoi_id", "id as src", "0L as dst", "length_m"))
    src = spark.createDataFrame([("A", 7, 7), ("A", 10, 10)], "aoi_id string, node_id bigint, source bigint")
    got = network.nearest_sources(roads, src).selectExpr("count(*) n", "sum(dist_m) s", "min(source) a", "max(source) b").first()
    # both sources lie 1 and 4 metres from the hub, so the first one is nearer to all but the second itself
    assert (got.n, got.a, got.b) == (30_001, 7, 10)
    want = 1.0 + sum(1.0 + 1 + i % 7 for i in range(1, 30_001) if i not in (7, 10))
    assert got.s == want


def test_audit_by_road_flags_straight_lines(spark):
    nodes = spark.createDataFrame([("A", 1, 0.0, 0.0), ("A", 2, 0.01, 0.0), ("A", 3, 0.05, 0.0)], NODE)
    roads = spark.createDataFrame([("A", 1, 2, 3000.0), ("A", 2, 1, 2500.0)], EDGE)
    kind = "aoi_id string, demand_id bigint, lon double, lat double, weight double"
    demand = spark.createDataFrame([("A", 10, 0.0, 0.0001, 1.0), ("A", 11, 0.0101, 0.0, 3.0), ("A", 12, 0.0501, 0.0, 4.0), ("B", 13, 1.0, 1.0, 2.0)], kind)
    sites = spark.createDataFrame([("A", 5, 0.0, 0.0)], "aoi_id string, site_id bigint, lon double, lat double")
    near = {r.demand_id: r for r in audit.nearest_by_road(demand, sites, nodes, roads).collect()}
    assert (near[10].dist_m, near[10].on_road, near[11].dist_m, near[11].on_road) == (0.0, True, 3000.0, True)
    assert not near[12].on_road and near[12].dist_m > 5000 and 13 not in near
    assert {r.demand_id: r.dist_m for r in audit.nearest_by_road(demand, sites, nodes, roads, direction="to_site").collect()}[11] == 2500.0
    rows = {r.aoi_id: r for r in audit.analyze_facilities_network(demand, sites, 3000.0, nodes, roads).collect()}
    assert (rows["A"].pct_weight_covered, rows["A"].n_off_road, rows["B"].pct_weight_covered, rows["B"].n_off_road) == (50.0, 1, 0.0, 0)
    alone = {r.aoi_id: r for r in audit.analyze_facilities_network(demand, sites, 3000.0, nodes, roads.where("false")).collect()}
    assert alone["A"].n_off_road == 2  # the third stands at the site's own junction
    with pytest.raises(ValueError):
        audit.analyze_facilities_network(demand, sites.where("false"), 3000.0, nodes, roads)
