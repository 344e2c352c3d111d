"""Steps whose work must not grow with sites x demand, checked against the plain computation."""

import math
import random

import pytest
from pyspark.sql import functions as F

from catchment.location import pmedian

R = 6371008.8


def _hav(a, b):
    p, q = math.radians(a[1]), math.radians(b[1])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return math.floor(math.asin(min(1.0, math.sqrt(h))) * 2 * R * 1000 + 0.5) / 1000


def _points(n, seed, keys=("a", "b")):
    r = random.Random(seed)
    return [(k, i, 10 + r.random() * 0.8, 45 + r.random() * 0.6, 1.0 + r.randrange(50)) for k in keys for i in range(n)]


@pytest.fixture(scope="module")
def area(spark):
    demand, sites = _points(900, 1), [p[:4] for p in _points(300, 2)]
    d = spark.createDataFrame(demand, "aoi_id string, demand_id bigint, lon double, lat double, weight double")
    s = spark.createDataFrame(sites, "aoi_id string, site_id bigint, lon double, lat double")
    return demand, sites, d, s


def test_max_distance_screens_with_open_sites(area, monkeypatch):
    """More free sites than are costed outright, next to sites that the limit opens."""
    monkeypatch.setattr(pmedian, "EXACT_PAIRS", 0, raising=False)
    _, _, d, s = area
    got = pmedian.p_median_max_distance(d, s, 8, 30000.0).collect()
    assert {r.status for r in got} == {"feasible"}
    assert all(sum(r.aoi_id == k for r in got) == 8 for k in ("a", "b"))


def test_p_median_screening_keeps_the_best_and_little_else(area, monkeypatch):
    demand, sites, d, s = area
    monkeypatch.setattr(pmedian, "LAST_SIDE", pmedian.FIRST_SIDE)
    monkeypatch.setattr(pmedian, "FEW", 4)
    monkeypatch.setattr(pmedian, "EXACT_PAIRS", 0, raising=False)
    st = pmedian.GreedyState(d, s, ["aoi_id"])
    d1 = {(p[0], p[1]): pmedian.FAR_M for p in demand}
    for _ in range(2):
        left = {(r.aoi_id, r.site_id) for r in st.survivors(st.remaining()).collect()}
        assert len(left) <= 90  # of 600
        pick = st.best(st.remaining())
        at = {r.aoi_id: r for r in pick.collect()}
        for k in ("a", "b"):
            mine = [p for p in demand if p[0] == k]
            cost = {t[1]: round(sum(p[4] * min(d1[k, p[1]], _hav(p[2:4], t[2:4])) for p in mine)) for t in sites if t[0] == k}
            best = min(cost, key=lambda i: (cost[i], i))
            assert at[k].site_id == best and at[k].cost == pytest.approx(cost[best], abs=1)
            assert (k, best) in left
            for p in mine:
                d1[k, p[1]] = min(d1[k, p[1]], _hav(p[2:4], (at[k].lon, at[k].lat)))
        st.add(pick)


def _recorded(monkeypatch, module):
    """(label, table) of everything the module stores."""
    seen, store = [], module.table
    monkeypatch.setattr(module, "table", lambda df, label: seen.append((label, store(df, label))) or seen[-1][1])
    return seen


def test_p_median_shapes_cells_once_a_side_and_measures_a_pair_once(area, monkeypatch):
    """Cells keep centre and moments from round to round; both ends of a cost share one distance."""
    _, _, d, s = area
    monkeypatch.setattr(pmedian, "LAST_SIDE", pmedian.FIRST_SIDE)
    monkeypatch.setattr(pmedian, "FEW", 4)
    monkeypatch.setattr(pmedian, "EXACT_PAIRS", 0)
    want = pmedian.p_median_greedy(d, s, 3).orderBy("aoi_id", "step").collect()
    seen, plans = _recorded(monkeypatch, pmedian), []
    inner = pmedian.table
    monkeypatch.setattr(pmedian, "table", lambda df, label: (label == "ends" and plans.append(df._jdf.queryExecution().optimizedPlan().toString())) or inner(df, label))
    assert pmedian.p_median_greedy(d, s, 3).orderBy("aoi_id", "step").collect() == want
    labels = [n for n, _ in seen]
    assert labels.count("ends") == 3 and labels.count("cells") == 1 and labels.count("sites") == 1
    assert plans and all(p.count("ASIN(") == 1 for p in plans)


def test_probe_stores_no_pair_once_a_radius(spark, monkeypatch):
    from catchment.location import pcenter

    r = random.Random(5)
    at = [(r.random(), r.random()) for _ in range(90)]
    score = {(d, s): round(1000 * math.dist(at[d], at[60 + s]), 3) for d in range(60) for s in range(30)}
    radii = [float(x) for x in range(460, 1100, 9)]  # more than one part of bits
    pairs = spark.createDataFrame([("a", d, s, v, float("inf")) for (d, s), v in score.items()], "aoi_id string, demand_id bigint, site_id bigint, score double, own double")
    seen = _recorded(monkeypatch, pcenter)
    got = pcenter.p_center_probe(pairs, spark.createDataFrame([("a", x) for x in radii], "aoi_id string, r double"), 3).collect()
    want = set()
    for x in radii:
        left, picks = set(range(60)), []
        while left and len(picks) < 4:
            gain = {s: sum(score[d, s] <= x for d in left) for s in range(30)}
            best = min(gain, key=lambda s: (-gain[s], s))
            picks.append(best)
            left -= {d for d in left if score[d, best] <= x}
        if not left and len(picks) <= 3:
            want |= {(x, s) for s in picks}
    assert want and {(g.r, g.site_id) for g in got} == want
    assert max(t.count() for _, t in seen) <= len(score)


def test_p_center_without_a_radius_to_probe(spark):
    """Farthest-first meets the bound, so no score lies between."""
    from catchment.location import pcenter

    d = spark.createDataFrame([("a", i, float(i), 0.0, 1.0) for i in range(2)], "aoi_id string, demand_id bigint, lon double, lat double, weight double")
    s = spark.createDataFrame([("a", i, float(i), 0.0) for i in range(2)], "aoi_id string, site_id bigint, lon double, lat double")
    (row,) = pcenter.p_center(d, s, 2).collect()
    assert (row.objective, row.lower_bound, row.site_ids) == (0.0, 0.0, "0,1")


def test_small_work_is_costed_outright(area):
    _, _, d, s = area
    st = pmedian.GreedyState(d, s, ["aoi_id"])
    assert st.survivors(st.remaining()).count() == 600


def test_sets_are_judged_in_several_tasks(area, monkeypatch):
    from catchment.location import genetic

    _, _, d, s = area
    seen = _recorded(monkeypatch, genetic)
    monkeypatch.setattr(genetic, "release", lambda *t: None)
    genetic.evolve(d, s, "mclp", 3, 10000.0, population=6, generations=1)
    (spots,) = [t for label, t in seen if label == "spots"]
    assert spots.rdd.getNumPartitions() > 1
