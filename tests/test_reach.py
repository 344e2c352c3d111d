"""Covering models that never write their pairs give what the written pairs give."""

import random

import pytest
from pyspark.sql import functions as F

from catchment.location import cover
from catchment.operators import coverage

K = ["aoi_id"]


@pytest.fixture(scope="module")
def region(spark):
    """Two areas, one of them across the date line, with sites given twice and demand without a place."""
    r = random.Random(4)
    west = {"a": 10.0, "b": 179.7}
    lon = lambda k: (west[k] + r.random() * 0.6 + 180.0) % 360.0 - 180.0
    d = [(k, i, lon(k), 45 + r.random() * 0.4, 1.0 + r.randrange(5000) / 100) for k in west for i in range(700)] + [("a", 9001, None, 45.0, 1.0)]
    s = [(k, i, lon(k), 45 + r.random() * 0.4, 0.7 + 0.05 * r.randrange(6), 100.0 + 25 * r.randrange(9)) for k in west for i in range(90)]
    s += [s[5], s[100]]
    d = spark.createDataFrame(d, "aoi_id string, demand_id bigint, lon double, lat double, weight double")
    return d, spark.createDataFrame(s, "aoi_id string, site_id bigint, lon double, lat double, reliability double, cost double")


def both(region, radius, **how):
    d, s = region
    return cover.cover_pairs(d, s, radius, K, **how), cover.cover_reach(d, s, radius, K, **how)


def rows(df):
    return sorted(tuple(round(v, 4) if isinstance(v, float) else v for v in r) for r in df.collect())


def test_sums_in_reach_equal_pairs(region):
    d, s = region
    c = s.select(*K, "site_id", "lon", "lat", F.when(F.col("site_id") % 2 == 0, 9000.0).otherwise(16000.0).alias("reach")).dropDuplicates()
    got = coverage.rows_in_reach(d.where("lon is not null"), c, "reach", 16000.0, K, [], ["weight"], 7)
    pairs = coverage.pairs_within(d, c, 16000.0, K).where("dist_m <= reach")
    assert got.count() < 0.7 * pairs.count()
    total = lambda df: rows(df.groupBy("aoi_id", "site_id").agg(F.sum("weight")))
    assert total(got) == total(pairs)


@pytest.mark.parametrize("model", ["probabilistic", "backup", "forced"])
def test_greedy_without_pairs(region, model):
    how, opts = {}, {}
    if model == "probabilistic":
        how = {"coef": F.col("reliability")}
    if model == "backup":
        how, opts = {"need": 2.0}, {"gain": cover.multi_gain(2.0)}
    if model == "forced":
        ends = region[1].groupBy(*K)
        opts = {"must_open": ends.agg(F.min("site_id").alias("site_id")), "must_close": ends.agg(F.max("site_id").alias("site_id"))}
    pairs, near = both(region, 7000.0, **how)
    want = rows(cover.greedy_p(pairs, 2, **opts))
    assert len(want) >= 4 and rows(cover.greedy_p(near, 2, **opts)) == want


def test_budget_partial_and_bound_without_pairs(region):
    d, s = region
    pairs, near = both(region, 7000.0)
    total = d.groupBy(*K).agg(F.sum("weight").alias("total"))
    costs = s.dropDuplicates([*K, "site_id"])
    for model in (
        lambda p: cover.greedy_budget(p, costs, 500.0),
        lambda p: cover.partial_cover(p, total, 0.5),
        lambda p: cover.mclp_bound(p, cover.greedy_p(p, 2), 2),
    ):
        assert rows(model(near)) == rows(model(pairs)) != []


def test_set_cover_without_pairs(region, monkeypatch):
    """Some rounds by place, the rest on the pairs that are left then."""
    pairs, near = both(region, 7000.0, value=F.lit(1.0), need=cover.log_need(0.95), coef=cover.log_coef())
    monkeypatch.setattr(cover, "PAIRS_AT_ONCE", 5000)
    ends = region[1].groupBy(*K)
    first, last = (ends.agg(f("site_id").alias("site_id")) for f in (F.min, F.max))
    got = cover.set_cover(near, K, first, last)
    assert rows(got) == rows(cover.set_cover(pairs, K, first, last)) != []
    assert rows(cover.cover_status(*region, near, got)) == rows(cover.cover_status(*region, pairs, got))


def test_packing_without_pairs(region, monkeypatch):
    pairs, near = both(region, 7000.0, value=F.lit(1.0))
    monkeypatch.setattr(cover, "PAIRS_AT_ONCE", 3000)
    assert rows(cover.packing_bound(near)) == rows(cover.packing_bound(pairs)) != []
