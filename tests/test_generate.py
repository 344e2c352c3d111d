"""Points drawn inside areas: exact numbers, inside, evenly spread."""

import math

from pyspark.sql import functions as F

from catchment.operators.polygon import clip_to_own_polygon
from catchment.plans import generate

RINGS = {
    "strip": [[(0, 0), (10, 10), (10, 10.001), (0, 0.001)]],
    "square with hole": [[(0, 0), (4, 0), (4, 4), (0, 4)], [(1, 1), (1, 3), (3, 3), (3, 1)]],
    "star": [[(5 + (3 if i % 2 else 1) * math.cos(i * math.pi / 150), 5 + (3 if i % 2 else 1) * math.sin(i * math.pi / 150)) for i in range(300)]],
    "wide": [[(0, 0), (1, 0), (1, 60), (0, 60)]],
}


def edges_of(spark, rings):
    rows = []
    for key, loops in rings.items():
        for loop in loops:
            for (a, b), (c, d) in zip(loop, loop[1:] + loop[:1]):
                rows.append((key, len(rows), float(a), float(b), float(c), float(d)))
    return spark.createDataFrame(rows, "aoi_id string, seq int, x1 double, y1 double, x2 double, y2 double")


def test_every_area_gets_all_its_points(spark):
    e = edges_of(spark, {**RINGS, "line": [[(0, 0), (1, 1)]], "flat": [[(0, 2), (3, 2)]]})
    counts = spark.createDataFrame([(k, n) for k, n in zip([*RINGS, "line", "flat", "unknown"], (100, 9000, 700, 2000, 5, 5, 5))], "aoi_id string, n bigint")
    pts = generate.points_in_areas(counts, e).cache()
    got = {r.aoi_id: (r.n, r.lo, r.hi, r.d) for r in pts.groupBy("aoi_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("point_no").alias("lo"), F.max("point_no").alias("hi"), F.countDistinct("point_no").alias("d")).collect()}
    assert got == {k: (n, 1, n, n) for k, n in (("strip", 100), ("square with hole", 9000), ("star", 700), ("wide", 2000))}
    assert clip_to_own_polygon(pts, e, "point_no").groupBy("aoi_id").count().where("aoi_id <> 'strip'").agg(F.sum("count")).first()[0] == 11700
    assert pts.where("aoi_id = 'strip' and not (lat between lon - 1e-9 and lon + 0.001 + 1e-9)").count() == 0
    # the square without its hole: a left third of x < 1 holds 4 of 12
    left = pts.where("aoi_id = 'square with hole' and lon < 1").count()
    assert abs(left - 3000) < 200
    status = {r.aoi_id: r.status for r in generate.draw_status(counts, e).collect()}
    assert status == {**{k: "ok" for k in RINGS}, "line": "no extent", "flat": "no extent", "unknown": "no boundary"}


def test_sphere_is_even_by_area(spark):
    e = edges_of(spark, {"wide": RINGS["wide"]})
    n = spark.createDataFrame([("wide", 20000)], "aoi_id string, n bigint")
    pts = generate.points_in_areas(n, e, sphere=True)
    assert pts.count() == 20000
    share = pts.where("lat < 30").count() / 20000  # sin 30 / sin 60
    assert abs(share - 0.5 / math.sin(math.pi / 3)) < 0.002
