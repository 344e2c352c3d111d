"""Roads, polygons, merging, generated points, streams, messages, audit input checks."""

import heapq
import random
import struct

import pytest
from pyspark.sql import functions as F

from catchment.functions import text
from catchment.operators import dedup, hull, network, polygon
from catchment.plans import audit, generate, messages, places
from catchment.session import new_path
from catchment.sources import readers, wkb
from catchment.streaming import jobs

EDGE = "aoi_id string, src bigint, dst bigint, length_m double"


def dijkstra(edges, src):
    adj = {}
    for a, b, w in edges:
        adj.setdefault(a, []).append((b, w))
    dist, heap = {src: 0.0}, [(0.0, src)]
    while heap:
        d, n = heapq.heappop(heap)
        if d > dist[n]:
            continue
        for m, w in adj.get(n, []):
            if d + w < dist.get(m, 1e18):
                dist[m] = d + w
                heapq.heappush(heap, (d + w, m))
    return dist


def test_paths_equal_dijkstra_one_way_and_cut_off(spark):
    rnd = random.Random(4)
    e = [(rnd.randrange(30), rnd.randrange(30), float(rnd.randint(1, 9))) for _ in range(70)]
    df = spark.createDataFrame([("A", *x) for x in e], EDGE)
    src = spark.createDataFrame([("A", 0), ("A", 7)], "aoi_id string, node_id bigint")
    got = {(r.source, r.node): r.dist_m for r in network.shortest_paths(df, src).collect()}
    want = {(s, n): d for s in (0, 7) for n, d in dijkstra(e, s).items()}
    assert got == want
    cut = {(r.source, r.node): r.dist_m for r in network.shortest_paths(df, src, cutoff_m=6.0).collect()}
    assert cut == {k: v for k, v in want.items() if v <= 6.0}
    back = {(r.source, r.node): r.dist_m for r in network.shortest_paths(df, src, direction="to_site").collect()}
    assert back == {(s, n): d for s in (0, 7) for n, d in dijkstra([(b, a, w) for a, b, w in e], s).items()}


def test_unreachable_pairs_fall_back(spark):
    nodes = spark.createDataFrame([("A", 10, 0.0, 0.0), ("A", 99, 0.01, 0.0)], "aoi_id string, node_id bigint, lon double, lat double")
    roads = spark.createDataFrame([("A", 99, 98, 1.0)], EDGE)
    d = spark.createDataFrame([("A", 1, 0.0, 0.0)], "aoi_id string, demand_id bigint, lon double, lat double")
    s = spark.createDataFrame([("A", 2, 0.01, 0.0)], "aoi_id string, site_id bigint, lon double, lat double")
    r = network.network_pairs(d, s, nodes, roads, 5000.0).first()
    assert not r.on_road and r.dist_m > 1000


def test_polygon_with_hole(spark):
    def ring(x0, y0, x1, y1):
        return [(x0, y0, x1, y0), (x1, y0, x1, y1), (x1, y1, x0, y1), (x0, y1, x0, y0)]

    rows = [("P", i, *map(float, r)) for i, r in enumerate(ring(0, 0, 4, 4) + ring(1, 1, 2, 2))]
    edges = spark.createDataFrame(rows, "poly string, seq int, x1 double, y1 double, x2 double, y2 double")
    pts = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.5, 1.5), (3, 5.0, 0.5), (4, 3.3, 3.7)], "id bigint, lon double, lat double")
    got = {r.id for r in polygon.points_in_polygons(pts, edges, ["id"], ["poly"]).collect()}
    assert got == {1, 4}


def poi(spark, rows):
    return spark.createDataFrame([("A", *r, ["x"]) for r in rows], "aoi_id string, poi_id bigint, name string, amenity string, lon double, lat double, sources array<string>")


def test_merge_by_distance_and_name(spark):
    a = poi(spark, [(1, "St. Mary Hospital", "h", 36.8, -1.3)])
    near = poi(spark, [(2, "St Mary Hospital", "h", 36.8001, -1.3001)])
    far = poi(spark, [(2, "St Mary Hospital", "h", 36.9, -1.3)])
    other = poi(spark, [(2, "Depot North", "h", 36.8001, -1.3001)])
    blank = poi(spark, [(2, "", "h", 36.8001, -1.3001)])
    assert [dedup.merge_providers(a, b).count() for b in (near, far, other, blank)] == [1, 2, 2, 1]


def test_many_copies_merge_into_one(spark):
    a = poi(spark, [(i, "Clinic A", "h", 36.8, -1.3) for i in range(40)])
    b = poi(spark, [(1000 + i, "clinic a", "h", 36.8, -1.3) for i in range(40)])
    assert dedup.merge_providers(a, b).count() == 40


def test_names(spark):
    df = spark.createDataFrame([("St. Mary Hospital", "St Mary Hospital"), ("A B C", "A D E"), (None, "x")], "a string, b string")
    assert [r[0] for r in df.select(text.name_similar(F.col("a"), F.col("b"))).collect()] == [True, False, True]


def test_hull_contains_every_point(spark):
    rnd = random.Random(6)
    pts = [("A", rnd.gauss(0, 1), rnd.gauss(0, 1)) for _ in range(2000)]
    h = hull.convex_hull(spark.createDataFrame(pts, "aoi_id string, lon double, lat double")).orderBy("seq").collect()
    c = [(r.x, r.y) for r in h]
    for (x1, y1), (x2, y2) in zip(c, c[1:] + c[:1]):
        assert all((x2 - x1) * (y - y1) - (y2 - y1) * (x - x1) >= -1e-12 for _, x, y in pts)


def test_thinned_points_keep_their_distance(spark):
    rnd = random.Random(9)
    pts = [("A", i, 10 + rnd.uniform(0, 0.05), 50 + rnd.uniform(0, 0.05)) for i in range(200)]
    t = generate.thin_points(spark.createDataFrame(pts, "aoi_id string, site_id bigint, lon double, lat double"), 60)
    assert 0 < t.count() <= 60
    same = generate.thin_points(spark.createDataFrame(pts[::-1], "aoi_id string, site_id bigint, lon double, lat double"), 60)
    assert sorted(t.collect()) == sorted(same.collect())


def test_audit_rejects_bad_input(spark):
    d = spark.createDataFrame([("A", 1, 0.0, 0.0, 1.0)], "aoi_id string, demand_id bigint, lon double, lat double, weight double")
    s = spark.createDataFrame([("A", 1, 0.0, 0.0)], "aoi_id string, site_id bigint, lon double, lat double")
    with pytest.raises(ValueError):
        audit.analyze_facilities(d, s, 0.0)
    with pytest.raises(ValueError):
        audit.analyze_facilities(d.limit(0), s, 100.0)


@pytest.mark.parametrize(
    "message, field, value",
    [
        ("place 5 facilities within 2 km", "n_facilities", 5), ("place 5 facilities within 2 km", "radius_m", 2000.0),
        ("budget variant: budget of 300", "budget", 300.0), ("k = 2", "k_coverage", 2), ("sr=90ft", "radius_m", 90 * 0.3048),
        ("radius of 700", "radius_m", 700.0), ("weights are from 1 to 9", "weight_hi", 9.0), ("a budget of 300", "budget", None),
    ],
)
def test_slots(spark, message, field, value):
    got = messages.extract_slots(spark.createDataFrame([(1, message)], "id int, text string")).first()[field]
    assert got == value if not isinstance(value, float) else abs(got - value) < 1e-9


def test_late_events_are_dropped(spark):
    path = new_path(spark, "late")
    sql = "cast('2024-01-01 {}' as timestamp) as ts, 's' as session_id, {} as event_id, 'a' as stage, 'ok' as status, 1.0e0 as duration_ms"
    for i, t in enumerate(("00:01:00", "02:00:00", "02:01:00", "00:02:00", "01:55:00", "03:00:00")):
        spark.sql("select " + sql.format(t, i)).coalesce(1).write.mode("append").parquet(path)
    import glob
    import os

    files = glob.glob(path + "/*.parquet")
    order = {f: spark.read.parquet(f).first().event_id for f in files}
    for f, i in order.items():
        os.utime(f, (1_700_000_000 + i * 100, 1_700_000_000 + i * 100))
    st = (
        spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)
    )
    rows = jobs.run_append(jobs.stage_metrics(st), "late").collect()
    total = {str(r.start)[11:16]: r.n for r in rows}
    # 00:02 came after the watermark had passed its window; 01:55 was still in time
    assert total["00:00"] == 1 and total["01:55"] == 1 and total["02:00"] == 2


def test_audit_keeps_areas_without_sites(spark):
    d = spark.createDataFrame([("A", 1, 0.0, 0.0, 1.0), ("B", 1, 0.0, 0.0, 2.0), ("B", 2, 0.1, 0.0, 3.0)], "aoi_id string, demand_id bigint, lon double, lat double, weight double")
    s = spark.createDataFrame([("A", 1, 0.0, 0.0)], "aoi_id string, site_id bigint, lon double, lat double")
    got = {r.aoi_id: r for r in audit.analyze_facilities(d, s, 100.0).collect()}
    assert got["A"].pct_weight_covered == 100.0
    b = got["B"]
    assert (b.n_demand, b.n_facilities, b.pct_weight_covered, b.uncovered_weight, b.avg_distance_m) == (2, 0, 0.0, 5.0, None)


def test_hull_drops_inner_points_before_python(spark):
    rnd = random.Random(1)
    pts = [("A", rnd.uniform(0, 1), rnd.uniform(0, 1)) for _ in range(3000)]
    df = spark.createDataFrame(pts, "aoi_id string, lon double, lat double")
    got = [(r.x, r.y) for r in hull.convex_hull(df).orderBy("seq").collect()]
    turn = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    assert all(turn(a, b, (x, y)) >= 0 for a, b in zip(got, got[1:] + got[:1]) for _, x, y in pts)


def test_well_known_binary_with_more_axes_and_reference_ids(spark):
    ring = [(0.0, 0.0, 5.0), (1.0, 0.0, 6.0), (1.0, 1.0, 7.0), (0.0, 0.0, 5.0)]
    flat = [c for p in ring for c in p]
    iso_z = struct.pack("<BIII12d", 1, 1003, 1, 4, *flat)
    flag_z = struct.pack("<BIIII12d", 1, 3 | 0x80000000 | 0x20000000, 4326, 1, 4, *flat)
    point = struct.pack(">BIIdd", 0, 1 | 0x20000000, 4326, 1.0, 2.0)
    multi = struct.pack("<BII", 1, 1004, 2) + struct.pack("<BIddd", 1, 1001, 1.0, 2.0, 9.0) + struct.pack("<BIddd", 1, 1001, 3.0, 4.0, 9.0)
    df = spark.createDataFrame([(1, bytearray(iso_z)), (2, bytearray(flag_z)), (3, bytearray(point)), (4, bytearray(multi))], "id int, g binary")
    got = {}
    for r in wkb.decode_edges(df, "g", ["id"]).orderBy("id", "ring_no", "seq").collect():
        got.setdefault(r.id, []).append((r.x1, r.y1, r.x2, r.y2))
    edges = [(0.0, 0.0, 1.0, 0.0), (1.0, 0.0, 1.0, 1.0), (1.0, 1.0, 0.0, 0.0)]
    assert got == {1: edges, 2: edges, 3: [(1.0, 2.0, 1.0, 2.0)], 4: [(1.0, 2.0, 1.0, 2.0), (3.0, 4.0, 3.0, 4.0)]}


def test_nothing_is_cut_from_places(spark):
    many = spark.range(30_000).selectExpr(
        "id", "named_struct('primary', concat('Lima ', id)) as names", "named_struct('primary', 'shop') as categories", "cast(null as binary) as geometry",
        "named_struct('xmin', 0d, 'xmax', 1d, 'ymin', 0d, 'ymax', 1d) as bbox", "'locality' as subtype", "'PE' as country", "1 as population",
        "array('Shop') as labels", "'x' as name", "0.5d as longitude", "0.5d as latitude",
    )
    box = (0.0, 0.0, 1.0, 1.0)
    assert readers.scan_places(many, box, ["shop"]).count() == 30_000
    assert readers.search_divisions(many, box, ["locality"], "lima").count() == 30_000
    assert readers.scan_places_by_label(many, box, ["shop"]).count() == 30_000
    assert readers.scan_places(many, box, ["shop"], limit=7).count() == 7


def test_the_eighth_division_is_tried_and_all_sites_are_labelled(spark):
    m = spark.createDataFrame([("q", i, "Lima", "locality", "lima") for i in range(9)], "q string, id bigint, name string, subtype string, wanted string")
    assert places.best_division(m, m.where("id = 8"), ["q"]).first().id == 8
    s = spark.createDataFrame([("A", i, i / 10, 0.0) for i in range(25)], "aoi_id string, site_id bigint, lon double, lat double")
    g = s.select("aoi_id", F.col("site_id").alias("place_id"), "lon", "lat", F.concat(F.lit("p"), "site_id").alias("label"))
    assert {(r.site_id, r.place) for r in places.label_facilities(s, g).collect()} == {(i, f"p{i}") for i in range(25)}
