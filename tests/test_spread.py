"""Work that grows with pairs or Python calls, not with bytes, is dealt over tasks."""

import random

from pyspark.sql import functions as F

from catchment.functions import geo, sql
from catchment.location import sweep
from catchment.operators import coverage

D = "aoi_id string, demand_id bigint, lon double, lat double, weight double"
S = "aoi_id string, site_id bigint, lon double, lat double"


def _points(spark, n, seed, cols):
    r = random.Random(seed)
    return spark.createDataFrame([("a", i, 10 + r.random() * 0.8, 45 + r.random() * 0.6, 1.0 + r.randrange(50))[: cols.count(",") + 1] for i in range(n)], cols)


def _tasks(df):
    """Tasks that hold rows."""
    return df.select(F.spark_partition_id().alias("t")).distinct().count()


def test_range_join_is_dealt_by_number(spark):
    d, s = _points(spark, 400, 1, D), _points(spark, 60, 2, S)
    pairs = coverage.pairs_within(d, s, 9000.0)
    assert _tasks(pairs) > 1
    own = geo.Haversine.dist(F.col("lon"), F.col("lat"), F.col("_x"), F.col("_y"))
    plain = d.join(s.withColumnsRenamed({"lon": "_x", "lat": "_y"}), "aoi_id").select("demand_id", "site_id", own.alias("dist_m")).where("dist_m <= 9000")
    got = pairs.select("demand_id", "site_id", "dist_m")
    assert got.count() == plain.count() > 0 and got.exceptAll(plain).isEmpty()


def test_crowded_cell_is_split(spark):
    d = spark.range(9000).selectExpr("'a' as aoi_id", "id as demand_id", "10e0 as lon", "45e0 + id * 1e-7 as lat", "1e0 as weight")
    s = spark.createDataFrame([("a", 1, 10.0, 45.0)], S)
    pairs = coverage.pairs_within(d, s, 9000.0)
    assert pairs.count() == 9000 and _tasks(pairs) > 1


def test_geodesic_is_computed_once_a_pair(spark):
    d, s = _points(spark, 40, 1, D), _points(spark, 6, 2, S)
    plan = coverage.geodesic_pairs(d, s, 9000.0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("_inverse(") + plan.count("_vincenty(") == 1


def test_sweep_writes_no_pairs_and_takes_radii_of_any_size(spark, monkeypatch):
    d, s = _points(spark, 300, 1, D), _points(spark, 40, 2, S)
    seen, store = [], sweep.table
    monkeypatch.setattr(sweep, "table", lambda df, label: seen.append((label, store(df, label))) or seen[-1][1])
    radii = [("tiny", 900.0), ("wide", 30000.0), ("twin", 30000.0), ("bad", 0.0)]
    got = {r.scenario_id: r for r in sweep.radius_sweep_mclp(d, s, spark.createDataFrame(radii, "scenario_id string, radius_m double"), 1).collect()}
    assert "pairs" not in {label for label, _ in seen}
    near = coverage.pairs_within(d, s, 30000.0).cache()
    for name, r in radii[:3]:
        best = near.where(F.col("dist_m") <= r).groupBy("site_id").agg(F.sum("weight").alias("w")).agg(F.max("w")).first()[0]
        assert got[name].covered == best
    assert got["bad"].error and got["bad"].covered is None


def test_edges_of_geometries_are_made_without_a_batch_a_row(spark):
    sql.register(spark)
    plan = spark.sql("select e.* from values (cast(null as binary)) t(w), lateral wkb_to_edges(w) e")._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEval" not in plan and "EvalPythonUDTF" in plan
