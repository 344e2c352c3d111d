"""Prefix sums and order statistics against plain Python, with heavy ties."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from catchment.operators import measures, running


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(1)
    out = []
    for aoi in ("A", "B"):
        for i in range(400):
            d = 777.5 if i % 3 == 0 else round(rnd.uniform(0, 5000), 3)
            out.append((aoi, i, d, round(rnd.uniform(0.5, 9), 2)))
    return out


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "aoi_id string, demand_id bigint, dist_m double, weight double")


def group(rows, aoi):
    r = [x for x in rows if x[0] == aoi]
    return np.array([x[2] for x in r]), np.array([x[3] for x in r])


def test_percentile_and_gini(df, rows):
    acc = {r.aoi_id: r for r in measures.access_summary(df).collect()}
    gin = {r.aoi_id: r.gini for r in measures.gini(df).collect()}
    for a in ("A", "B"):
        d, w = group(rows, a)
        assert abs(acc[a].p90_distance_m - np.percentile(d, 90)) < 0.002
        o = np.argsort(d)
        cw, cv = np.cumsum(w[o]), np.cumsum((d * w)[o])
        lor, pop = np.concatenate([[0], cv / cv[-1]]), np.concatenate([[0], cw / cw[-1]])
        assert abs(gin[a] - (1 - 2 * np.trapezoid(lor, pop))) < 1e-6


def test_worst_served_with_a_tied_edge(spark):
    # the ten-percent edge falls inside a group of equal distances
    data = [("A", i, 100.0 if i < 50 else 10.0, 1.0) for i in range(100)]
    d = spark.createDataFrame(data, "aoi_id string, demand_id bigint, dist_m double, weight double")
    assert running.worst_served(d, ["aoi_id"]).first().bottom_decile_m == 100.0
    one = spark.createDataFrame([("A", 1, 5.0, 1.0), ("A", 2, 9.0, 1.0)], "aoi_id string, demand_id bigint, dist_m double, weight double")
    assert running.worst_served(one, ["aoi_id"]).first().bottom_decile_m == 9.0


def test_gini_degenerate(spark):
    z = spark.createDataFrame([("A", 1, 0.0, 1.0), ("A", 2, 0.0, 1.0), ("B", 3, 4.0, 1.0)], "aoi_id string, demand_id bigint, dist_m double, weight double")
    assert {r.aoi_id: r.gini for r in measures.gini(z).collect()} == {"A": 0.0, "B": 0.0}


def test_id_ranks_over_wide_ids(spark):
    rnd = random.Random(2)
    ids = sorted({rnd.randrange(1 << 52) for _ in range(300)} | set(range(200)))
    df = spark.createDataFrame([("A", i) for i in ids], "k string, i bigint").repartition(5)
    got = {r.i: r.r for r in running.id_ranks(df, ["k"], "i", "r").collect()}
    assert got == {v: n for n, v in enumerate(ids, 1)}


def test_totals_by_order(spark, df):
    h = running.distance_histogram(df, ["aoi_id"])
    r = running.running_totals(h, ["aoi_id"], "d", ["n"], width=50.0).orderBy("aoi_id", "d").collect()
    last = {}
    for x in r:
        assert x.cum_n == last.get(x.aoi_id, 0) + x.n
        last[x.aoi_id] = x.cum_n
    assert last == {"A": 400, "B": 400}


def test_top_n_is_trimmed_before_the_shuffle(df):
    plan = measures.top_n(df, ["aoi_id"], [F.desc("dist_m")], 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
