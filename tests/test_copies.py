"""Copied rows are joined without being sent to the driver, and runs of cells hold round a pole."""

import random
import re

import pytest
from pyspark.sql import functions as F

from catchment.location import cover
from catchment.operators import coverage

K = ["aoi_id"]


def points(spark, name, rows):
    return spark.createDataFrame([("a", i, *r) for i, r in enumerate(rows)], f"aoi_id string, {name} bigint, lon double, lat double, weight double")


@pytest.fixture(scope="module")
def pole(spark):
    r = random.Random(6)
    place = lambda: (r.uniform(-180, 180), r.choice([-1, 1]) * r.uniform(89.2, 90.0), 1.0 + r.randrange(900) / 100)
    return points(spark, "demand_id", [place() for _ in range(900)]), points(spark, "site_id", [place() for _ in range(60)] + [(0.0, 90.0, 1.0)])


def plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_copied_sites_are_never_broadcast(pole):
    """A small table of sites becomes many rows by cell; the planner takes it for small all the same."""
    d, s = pole
    for df in (
        coverage.pairs_within(d, s.drop("weight"), 9000.0),
        coverage.rows_in_reach(d, s.select(*K, "site_id", "lon", "lat", F.lit(9000.0).alias("reach")), "reach", 9000.0, K, [], ["weight"], 5),
    ):
        text = plan(df)
        assert "SortMergeJoin" in text and not re.search(r"BroadcastHashJoin .*Inner", text)


def test_rounds_do_not_broadcast_by_demand(pole, spark):
    d, s = pole
    pairs = cover.cover_pairs(d, s.drop("weight"), 9000.0, K)
    assert not re.search(r"BroadcastHashJoin .*demand_id", plan(cover.local_winners(pairs, K)))


@pytest.mark.parametrize("fine", [2, 9])
def test_sums_round_a_pole(pole, fine):
    d, s = pole
    c = s.select(*K, "site_id", "lon", "lat", F.when(F.col("site_id") % 3 == 0, 30000.0).otherwise(7000.0).alias("reach"))
    total = lambda df: sorted((r[0], round(r[1], 4)) for r in df.groupBy("site_id").agg(F.sum("weight")).collect())
    got = coverage.rows_in_reach(d, c, "reach", 30000.0, K, [], ["weight"], fine)
    assert total(got) == total(coverage.pairs_within(d, c, 30000.0, K).where("dist_m <= reach")) != []
