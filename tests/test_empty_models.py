"""Models without sites, money or room to choose."""

import pytest
from pyspark.sql import functions as F

from catchment.functions import sql
from catchment.location import genetic, pcenter, pmedian

DEM = "aoi_id string, demand_id bigint, lon double, lat double, weight double"
SITE = "aoi_id string, site_id bigint, lon double, lat double, cost double"


@pytest.fixture(scope="module")
def small(spark):
    d = spark.createDataFrame([("A", i, i * 0.01, 0.0, 1.0) for i in range(12)], DEM)
    return d, spark.createDataFrame([("A", i, i * 0.02, 0.0, 50.0) for i in range(6)], SITE)


def test_nothing_affordable(small):
    none = pmedian.p_median_budget(*small, 2, 10.0)
    assert none.columns == ["aoi_id", "step", "site_id", "cost", "spent"] and none.count() == 0


def test_center_without_sites(small):
    d, s = small
    none = pcenter.p_center(d, s.where("false"), 2)
    assert none.columns == ["aoi_id", "objective", "lower_bound", "site_ids"] and none.count() == 0


@pytest.mark.parametrize("p", [4, 5, 6, 9])
def test_search_sets_hold_exactly_p_sites(small, p):
    d, s = small
    ranked = genetic._ranked_sites(s, ["aoi_id"])
    sets = genetic.first_sets(ranked, ["aoi_id"], p, 25, 1)
    whole = lambda kids: all(len({x.site_id for x in k}) == len(k) == min(p, 6) for k in kids)
    row = sets.first()
    assert len(row.kids) == 25 and whole(row.kids)
    pool = F.transform("kids", lambda x: F.struct(F.lit(1.0).alias("score"), F.lit(0).alias("born"), x.alias("sites")))
    state = sets.select("aoi_id", "n", pool.alias("pool"), F.lit(1.0).alias("best"), F.lit(0).alias("idle"), F.lit(0).alias("gen"))
    born = genetic.next_sets(state, ranked, ["aoi_id"], p, 25, 1).first()
    assert len(born.kids) == 22 and len(born.elite) == 3 and whole(born.kids) and born.gen == 1


def test_search_without_sites_or_sense(small):
    d, s = small
    none = genetic.evolve(d, s.where("false"), "mclp", 2, 500.0)
    assert none.columns == ["aoi_id", "objective", "n_uncovered", "generation", "last_generation", "n_sites", "site_ids"] and none.count() == 0
    for model, p, r in (("p-median", None, None), ("p-median", 0, None), ("lscp", 3, 10.0), ("mclp", 2, None), ("mclp", 2, -1.0), ("other", 2, 1.0)):
        with pytest.raises(ValueError):
            genetic.evolve(d, s, model, p, r)


def test_functions_from_sql_text(spark):
    sql.register(spark)
    row = spark.sql("select haversine_m(0, 0, 1, 0) as d, to_metres(2, 'km') as m, to_metres(2, null) as n, to_metres(2, 'x') as u, from_metres(2000, 'KM') as k, name_similar(null, 'a') as s").first()
    assert abs(row.d - 111195.08) < 0.1 and (row.m, row.n, row.u, row.k, row.s) == (2000.0, 2.0, None, 2.0, True)
    assert spark.sql("select * from values (cast(null as binary)) t(w), lateral wkb_to_edges(w)").count() == 0
