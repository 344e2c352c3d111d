"""Capacity in the choice of p-median sites."""

from pyspark.sql import functions as F

from catchment.functions import geo
from catchment.location import pmedian


def test_choice_leaves_room_for_all_demand(spark):
    # A: three small sites amid the demand, one large far away; B: nothing holds its demand; C: no site
    dem = [("A", i, float(i % 10), float(i // 10), 5.0) for i in range(20)] + [("A", 90, 5.0, 1.0, 10.0)]
    dem += [("B", 1, 0.0, 0.0, 50.0), ("B", 2, 1.0, 0.0, 50.0), ("C", 1, 0.0, 0.0, 1.0)]
    sit = [("A", 1, 2.0, 1.0, 20.0), ("A", 2, 5.0, 1.0, 20.0), ("A", 3, 7.0, 1.0, 30.0), ("A", 4, 300.0, 0.0, 90.0), ("B", 1, 0.0, 0.0, 60.0), ("B", 2, 1.0, 0.0, 30.0)]
    d = spark.createDataFrame(dem, "aoi_id string, demand_id bigint, lon double, lat double, weight double")
    s = spark.createDataFrame(sit, "aoi_id string, site_id bigint, lon double, lat double, capacity double")
    plain = {r.site_id for r in pmedian.p_median_greedy(d.where("aoi_id = 'A'"), s, 2, metric=geo.Planar).collect()}
    assert 4 not in plain
    steps, rows = pmedian.p_median_capacitated(d, s, 2, metric=geo.Planar)
    # 110 to place: only 4 with one of the others can hold it
    got = {(r.aoi_id, r.site_id) for r in steps.collect()}
    assert len(got) == 2 and ("A", 4) in got and {a for a, _ in got} == {"A"}
    rows = rows.cache()
    assert rows.count() == len(dem)
    load = rows.where("site_id is not null").join(s, ["aoi_id", "site_id"]).groupBy("aoi_id", "site_id").agg(F.sum("weight").alias("w"), F.max("capacity").alias("c"))
    assert load.where("w > c").count() == 0
    status = {(r.aoi_id, r.status): r["count"] for r in rows.groupBy("aoi_id", "status").count().collect()}
    assert status == {("A", "assigned"): 21, ("B", "over capacity"): 2, ("C", "over capacity"): 1}


def test_no_area_with_room(spark):
    d = spark.createDataFrame([("B", 1, 0.0, 0.0, 50.0)], "aoi_id string, demand_id bigint, lon double, lat double, weight double")
    s = spark.createDataFrame([("B", 1, 0.0, 0.0, 6.0)], "aoi_id string, site_id bigint, lon double, lat double, capacity double")
    steps, rows = pmedian.p_median_capacitated(d, s, 1)
    assert steps.count() == 0
    assert [(r.site_id, r.status) for r in rows.collect()] == [(None, "over capacity")]
