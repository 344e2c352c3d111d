"""Coverage, access, equity and utilisation measures; rankings and set operations."""

from pyspark.sql import functions as F

from ..functions import geo, scale
from ..functions.units import degradation_pct
from ..location import pmedian
from ..operators import coverage, measures, running
from ..operators.nearest import nearest_site
from ..session import materialize
from .location import OD, _greedy_parts
from .registry import NEAREST_SQL, hav, query

DC = ("demand", "candidates")
R = 10000.0
NR = "nr as (" + NEAREST_SQL + ")"


def _near(v):
    return materialize(nearest_site(v.demand(), v.candidates()), "nearest")


def _near_q(name, sql):
    """Register a function of the nearest-site relation."""
    def wrap(fn):
        return query(name, f"with {NR} {sql}", DC)(lambda v: fn(_near(v)))
    return wrap


@_near_q("coverage_summary", """select aoi_id, round(sum(case when dist_m<=10000 then weight else 0e0 end)/sum(weight)*100e0,6) as pct_weight_covered,
 round(avg(case when dist_m<=10000 then 100e0 else 0e0 end),6) as pct_points_covered, round(sum(weight)-sum(case when dist_m<=10000 then weight else 0e0 end),4) as uncovered_weight from nr group by 1""")
def coverage_summary(n):
    return measures.coverage_summary(n, R)


@_near_q("access_summary", "select aoi_id, round(sum(weight*dist_m)/sum(weight),3) as avg_distance_m, max(dist_m) as max_distance_m, round(quantile_cont(dist_m,0.9),3) as p90_distance_m from nr group by 1")
def access_summary(n):
    return measures.access_summary(n)


_WP = "(select min(d) from (select nr.dist_m d, sum(weight) over (order by dist_m) c, sum(weight) over () t from nr where nr.aoi_id = a.aoi_id) where round(c,6) >= round({q}e0*t,6))"


@_near_q("weighted_percentile", "select aoi_id, " + ", ".join(f"{_WP.format(q=q)} as p{int(q*100)}" for q in (0.5, 0.9, 0.95)) + " from (select distinct aoi_id from nr) a")
def weighted_percentile(n):
    rows = running.distribution(n, ["aoi_id"])
    return rows.groupBy("aoi_id").agg(*[running.weighted_percentile_expr(q).alias(f"p{int(q * 100)}") for q in (0.5, 0.9, 0.95)])


@_near_q("distance_distribution", "select aoi_id, round(sum(weight*dist_m)/sum(weight)/1e3,3) as mean_km, " + ", ".join(f"round({_WP.format(q=q)}/1e3,3) as {c}" for q, c in ((0.5, 'median_km'), (0.9, 'p90_km'), (0.95, 'p95_km')))
         + ", round(max(dist_m)/1e3,3) as max_km, round(min(dist_m)/1e3,3) as min_km, round(stddev_pop(dist_m)/1e3,3) as std_km from nr a group by aoi_id")
def distance_distribution(n):
    return measures.distance_distribution(n)


_GINI = """c as (select aoi_id, weight w, weight*dist_m wd, sum(weight*dist_m) over (partition by aoi_id order by dist_m, demand_id) cwd, sum(weight) over (partition by aoi_id) tw, sum(weight*dist_m) over (partition by aoi_id) twd from nr)"""


@_near_q("gini", f", {_GINI} select aoi_id, round(greatest(0e0, least(1e0, 1e0-sum(w*(2e0*cwd-wd))/(max(tw)*max(twd)))), 6) as gini from c group by 1")
def gini(n):
    return measures.gini(n)


@_near_q("bottom_decile_access", """, c as (select aoi_id, dist_m, weight, sum(weight) over (partition by aoi_id order by dist_m desc, demand_id) cw, sum(weight) over (partition by aoi_id) tw from nr)
 select a.aoi_id, round(coalesce(sum(c.weight*c.dist_m)/sum(c.weight), max(a.mx)), 3) as bottom_decile_m from (select aoi_id, max(dist_m) mx from nr group by 1) a left join c on c.aoi_id=a.aoi_id and round(cw,6)<=round(0.1e0*tw,6) group by 1""")
def bottom_decile_access(n):
    return running.worst_served(n, ["aoi_id"]).select("aoi_id", F.round("bottom_decile_m", 3).alias("bottom_decile_m"))


@_near_q("max_weighted_distance", "select aoi_id, round(max(weight*dist_m),2) as max_weighted_m from nr group by 1")
def max_weighted_distance(n):
    return n.groupBy("aoi_id").agg(F.round(F.max(F.col("weight") * F.col("dist_m")), 2).alias("max_weighted_m"))


@_near_q("pct_within_threshold", "select aoi_id, round(sum(case when dist_m<=10000 then weight else 0e0 end)/sum(weight)*100e0,6) as pct_within from nr group by 1")
def pct_within_threshold(n):
    w = F.col("weight")
    hit = F.coalesce(F.sum(F.when(F.col("dist_m") <= R, w)), F.lit(0.0))
    return n.groupBy("aoi_id").agg(F.round(measures.pct(hit, F.sum(w)), 6).alias("pct_within"))


@_near_q("cum_weight", ", h as (select aoi_id, dist_m as d, sum(weight) w, sum(weight*dist_m) wd from nr group by 1,2) select aoi_id, d, round(sum(w) over (partition by aoi_id order by d),4) as cum_w, round(sum(wd) over (partition by aoi_id order by d),0) as cum_wd from h")
def cum_weight(n):
    h = running.distance_histogram(n, ["aoi_id"])
    return running.running_totals(h, ["aoi_id"], "d", ["w", "wd"]).select("aoi_id", "d", F.round("cum_w", 4).alias("cum_w"), F.round("cum_wd", 0).alias("cum_wd"))


@_near_q("worst_access_topn", "select aoi_id, rank, demand_id, dist_m, weight, lon, lat from (select *, row_number() over (partition by aoi_id order by dist_m desc, demand_id) as rank from nr) where rank<=10")
def worst_access_topn(n):
    return measures.top_n(n, ["aoi_id"], [F.desc("dist_m"), F.asc("demand_id")], 10).select("aoi_id", "rank", "demand_id", "dist_m", "weight", "lon", "lat")


@_near_q("coverage_gaps_topn", "select aoi_id, rank, demand_id, round(dist_m/1e3,3) as distance_km, round(weight,2) as demand_weight from (select *, row_number() over (partition by aoi_id order by dist_m desc, demand_id) as rank from nr where dist_m>10000) where rank<=8")
def coverage_gaps_topn(n):
    g = measures.top_n(n.where(F.col("dist_m") > R), ["aoi_id"], [F.desc("dist_m"), F.asc("demand_id")], 8)
    return g.select("aoi_id", "rank", "demand_id", F.round(F.col("dist_m") / 1e3, 3).alias("distance_km"), F.round("weight", 2).alias("demand_weight"))


@_near_q("facility_breakdown", """select aoi_id, site_id, count(*) as n_demand, round(sum(weight),2) as served_weight, round(sum(weight*dist_m)/sum(weight)/1e3,3) as avg_km, round(max(dist_m)/1e3,3) as max_km from nr group by 1,2""")
def facility_breakdown(n):
    w, d = F.col("weight"), F.col("dist_m")
    g = n.groupBy("aoi_id", "site_id").agg(
        F.count(F.lit(1)).alias("n_demand"), F.round(F.sum(w), 2).alias("served_weight"),
        F.round(measures.weighted_mean(d, w) / 1e3, 3).alias("avg_km"), F.round(F.max(d) / 1e3, 3).alias("max_km"),
    )
    return g.orderBy("aoi_id", F.desc("served_weight"), "site_id")


@query("facility_density", """select c.aoi_id, n, round(n/a, 9) as per_km2, round(n/w*1000e0, 9) as per_1000 from (select aoi_id, count(*) n from candidates group by 1) c
 join (select aoi_id, sum(weight) w from demand group by 1) d using (aoi_id) join (select aoi_id, abs(sum(radians(x1)*6371008.8e0*sin(radians(y2))*6371008.8e0 - radians(x2)*6371008.8e0*sin(radians(y1))*6371008.8e0))/2e0/1e6 as a from boundary_edges group by 1) using (aoi_id)""",
       ("demand", "candidates", "boundary_edges"))
def facility_density(v):
    n = v.candidates().groupBy("aoi_id").agg(F.count(F.lit(1)).alias("n"))
    w = v.demand().groupBy("aoi_id").agg(F.sum("weight").alias("w"))
    j = n.join(w, "aoi_id").join(measures.polygon_area(v.boundary_edges()), "aoi_id")
    return j.select("aoi_id", "n", F.round(F.col("n") / F.col("area_km2"), 9).alias("per_km2"), F.round(F.col("n") / F.col("w") * 1000.0, 9).alias("per_1000"))


@_near_q("p_median_metrics", """select aoi_id, round(sum(weight*dist_m)/1e3, 0) as total_km, round(sum(weight*dist_m)/sum(weight)/1e3, 6) as mean_km, round(max(dist_m)/1609.344e0, 6) as max_mi, count(*) as n_demand, count(distinct site_id) as n_sites from nr group by 1""")
def p_median_metrics(n):
    w, d = F.col("weight"), F.col("dist_m")
    per_site = n.groupBy("aoi_id", "site_id").agg(F.sum(w * d).alias("wd"), F.sum(w).alias("w"), F.max(d).alias("mx"), F.count(F.lit(1)).alias("n"))
    return per_site.groupBy("aoi_id").agg(
        F.round(F.sum("wd") / 1e3, 0).alias("total_km"), F.round(F.sum("wd") / F.sum("w") / 1e3, 6).alias("mean_km"),
        F.round(F.max("mx") / 1609.344, 6).alias("max_mi"), F.sum("n").alias("n_demand"), F.count(F.lit(1)).alias("n_sites"),
    )


@_near_q("p_center_metrics", "select aoi_id, max(dist_m) as max_m, round(avg(dist_m),3) as mean_m, min(dist_m) as min_m, round(stddev_pop(dist_m),2) as std_m from nr group by 1")
def p_center_metrics(n):
    d = F.col("dist_m")
    return n.groupBy("aoi_id").agg(F.max(d).alias("max_m"), F.round(F.avg(d), 3).alias("mean_m"), F.min(d).alias("min_m"), F.round(F.stddev_pop(d), 2).alias("std_m"))


_OPEN = "site_id % 3 = 0"


@query("mclp_metrics", f"""with k as (select d.aoi_id, d.demand_id, d.weight, count(c.site_id) as n, min({hav('d', 'c')}) as dist from demand d left join (select * from candidates where {_OPEN}) c on c.aoi_id=d.aoi_id and {hav('d', 'c')} <= 10000 group by all)
 select aoi_id, round(sum(case when n>0 then weight else 0e0 end)/sum(weight)*100e0,6) as pct_weight, count(*) filter (n>0) as covered_points, count(*) filter (n=0) as uncovered_points, round(avg(dist) filter (n>0),3) as mean_covered_m, round(avg(n) filter (n>0),6) as mean_cover, min(n) filter (n>0) as min_cover from k group by 1""", DC)
def mclp_metrics(v):
    d, s = v.demand(), v.candidates().where(_OPEN)
    n = coverage.cover_counts(d, s, R).select("aoi_id", "demand_id", "n_sites")
    near = nearest_site(d, s, max_m=R).join(n, ["aoi_id", "demand_id"])
    hit = F.col("n_sites") > 0
    return near.groupBy("aoi_id").agg(
        F.round(F.coalesce(F.sum(F.when(hit, F.col("weight"))), F.lit(0.0)) / F.sum("weight") * 100.0, 6).alias("pct_weight"),
        F.count(F.when(hit, 1)).alias("covered_points"), F.count(F.when(~hit, 1)).alias("uncovered_points"),
        F.round(F.avg("dist_m"), 3).alias("mean_covered_m"), F.round(F.avg(F.when(hit, F.col("n_sites"))), 6).alias("mean_cover"),
        F.min(F.when(hit, F.col("n_sites"))).alias("min_cover"),
    )


@query("lscp_metrics", f"""with nn as (select d.aoi_id, d.demand_id, any_value(d.weight) weight, min({hav('d', 'c')}) as dist from demand d join (select * from candidates where {_OPEN}) c using (aoi_id) group by all)
 select aoi_id, nf as n_facilities, round(avg(case when dist<=10000 then 100e0 else 0e0 end),6) as pct_points, round(sum(case when dist<=10000 then weight else 0e0 end)/sum(weight)*100e0,6) as pct_weight, round(avg(dist),3) as mean_m, max(dist) as max_m
 from nn join (select aoi_id, count(*) nf from candidates where {_OPEN} group by 1) using (aoi_id) group by 1, 2""", DC)
def lscp_metrics(v):
    s = v.candidates().where(_OPEN)
    n = nearest_site(v.demand(), s).where("dist_m is not null")
    hit = F.col("dist_m") <= R
    g = n.groupBy("aoi_id").agg(
        F.round(F.avg(F.when(hit, 100.0).otherwise(0.0)), 6).alias("pct_points"),
        F.round(F.coalesce(F.sum(F.when(hit, F.col("weight"))), F.lit(0.0)) / F.sum("weight") * 100.0, 6).alias("pct_weight"),
        F.round(F.avg("dist_m"), 3).alias("mean_m"), F.max("dist_m").alias("max_m"),
    )
    return s.groupBy("aoi_id").agg(F.count(F.lit(1)).alias("n_facilities")).join(g, "aoi_id")


@query("capacity_utilisation", f"""with {NR}, s as (select aoi_id, site_id, sum(weight) w from nr group by 1,2), u as (select c.aoi_id, c.site_id, coalesce(w,0e0)/(capacity*100e0) as u, coalesce(w,0e0) w, capacity*100e0 cap from candidates c left join s using (aoi_id, site_id))
 select aoi_id, round(min(u),9) as min_u, round(avg(u),9) as avg_u, round(max(u),9) as max_u, round(max(least(1e0,u)),9) as max_clamped, round(sum(w)/sum(cap),9) as overall from u group by 1""", DC)
def capacity_utilisation(v):
    served = nearest_site(v.demand(), v.candidates()).groupBy("aoi_id", "site_id").agg(F.sum("weight").alias("w"))
    cap = F.col("capacity") * 100.0
    u = v.candidates().join(served, ["aoi_id", "site_id"], "left").select("aoi_id", F.coalesce("w", F.lit(0.0)).alias("w"), cap.alias("cap"))
    u = u.withColumn("u", F.col("w") / F.col("cap"))
    return u.groupBy("aoi_id").agg(
        F.round(F.min("u"), 9).alias("min_u"), F.round(F.avg("u"), 9).alias("avg_u"), F.round(F.max("u"), 9).alias("max_u"),
        F.round(F.max(F.least(F.lit(1.0), "u")), 9).alias("max_clamped"), F.round(F.sum("w") / F.sum("cap"), 9).alias("overall"),
    )


@query("budget_utilisation", f"select aoi_id, sum(cost) as total_cost, round(least(1e0, sum(cost)/2000e0),6) as used from candidates where {_OPEN} group by 1", ("candidates",))
def budget_utilisation(v):
    return v.candidates().where(_OPEN).groupBy("aoi_id").agg(F.sum("cost").alias("total_cost"), F.round(F.least(F.lit(1.0), F.sum("cost") / 2000.0), 6).alias("used"))


@query("reliability_summary", "select aoi_id, min(r) as min_r, round(avg(r),9) as mean_r, max(r) as max_r, count(*) filter (r<0 or r>1) as out_of_range from (select aoi_id, coalesce(case when site_id%7=0 then null else reliability end, 1e0) as r from candidates) group by 1", ("candidates",))
def reliability_summary(v):
    r = F.coalesce(F.when(F.col("site_id") % 7 != 0, F.col("reliability")), F.lit(1.0))
    return v.candidates().withColumn("r", r).groupBy("aoi_id").agg(
        F.min("r").alias("min_r"), F.round(F.avg("r"), 9).alias("mean_r"), F.max("r").alias("max_r"), F.count(F.when((F.col("r") < 0) | (F.col("r") > 1), 1)).alias("out_of_range")
    )


@_near_q("assignment_violations", "select aoi_id, count(*) as n, round(max(dist_m-12000e0),3) as max_excess, round(avg(dist_m-12000e0),3) as mean_excess from nr where dist_m>12000 group by 1")
def assignment_violations(n):
    e = F.col("dist_m") - 12000.0
    return n.where(F.col("dist_m") > 12000.0).groupBy("aoi_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.max(e), 3).alias("max_excess"), F.round(F.avg(e), 3).alias("mean_excess"))


@query("bounds_and_view", """select aoi_id, x0, x1, y0, y1, round((x0+x1)/2,9) as cx, round((y0+y1)/2,9) as cy, round(greatest(8e0, least(14e0, 11e0-log2(greatest(greatest(x1-x0,y1-y0),0.001e0)))),6) as zoom
 from (select aoi_id, min(lon) x0, max(lon) x1, min(lat) y0, max(lat) y1 from demand group by 1)""", ("demand",))
def bounds_and_view(v):
    b = v.demand().groupBy("aoi_id").agg(F.min("lon").alias("x0"), F.max("lon").alias("x1"), F.min("lat").alias("y0"), F.max("lat").alias("y1"))
    ext = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(0.001))
    return b.select("aoi_id", "x0", "x1", "y0", "y1", F.round((F.col("x0") + F.col("x1")) / 2, 9).alias("cx"), F.round((F.col("y0") + F.col("y1")) / 2, 9).alias("cy"),
                    F.round(F.greatest(F.lit(8.0), F.least(F.lit(14.0), 11.0 - F.log2(ext))), 6).alias("zoom"))


@query("polygon_area_km2", "select aoi_id, round(abs(sum(radians(x1)*6371008.8e0*sin(radians(y2))*6371008.8e0 - radians(x2)*6371008.8e0*sin(radians(y1))*6371008.8e0))/2e0/1e6,3) as area_km2 from boundary_edges group by 1", ("boundary_edges",))
def polygon_area_km2(v):
    return measures.polygon_area(v.boundary_edges()).select("aoi_id", F.round("area_km2", 3).alias("area_km2"))


@query("polygon_centroid", """select aoi_id, round(max(bx)+sum((x1-bx+x2-bx)*cr)/(3e0*sum(cr)),9) as lon, round(max(by_)+sum((y1-by_+y2-by_)*cr)/(3e0*sum(cr)),9) as lat, round(sum(cr)/2e0,9) as area_deg2 from (
 select *, (x1-bx)*(y2-by_)-(x2-bx)*(y1-by_) as cr from boundary_edges join (select aoi_id, min(x1) bx, min(y1) by_ from boundary_edges group by 1) using (aoi_id)) group by 1""", ("boundary_edges",))
def polygon_centroid(v):
    return measures.polygon_centroid(v.boundary_edges()).select("aoi_id", *[F.round(c, 9).alias(c) for c in ("lon", "lat", "area_deg2")])


@query("dataset_profile", """with r as (select aoi_id, demand_id, lon, lat, weight, case demand_id%4 when 0 then 'census' when 1 then 'survey' when 2 then 'model' else 'upload' end as src from demand)
 select aoi_id, count(*) as n_rows, min(lon) x0, max(lon) x1, min(lat) y0, max(lat) y1, round(avg(weight),6) as mean_weight, round(sum(weight),2) as total_weight,
 (select string_agg(src, ',' order by src) from (select distinct src from r q where q.aoi_id=r.aoi_id order by src limit 3)) as sources from r group by aoi_id""", ("demand",))
def dataset_profile(v):
    src = F.expr("case demand_id%4 when 0 then 'census' when 1 then 'survey' when 2 then 'model' else 'upload' end")
    d = v.demand().withColumn("src", src)
    # sources are thinned to distinct names before three are taken
    few = measures.top_n(d.select("aoi_id", "src").distinct(), ["aoi_id"], [F.asc("src")], 3).groupBy("aoi_id").agg(F.array_join(F.array_sort(F.collect_list("src")), ",").alias("sources"))
    g = d.groupBy("aoi_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("lon").alias("x0"), F.max("lon").alias("x1"), F.min("lat").alias("y0"), F.max("lat").alias("y1"),
        F.round(F.avg("weight"), 6).alias("mean_weight"), F.round(F.sum("weight"), 2).alias("total_weight"),
    )
    return g.join(few, "aoi_id")


@query("amenity_counts", "select aoi_id, amenity, count(*) as n, count(*) filter (amenity in ('clinic','hospital')) as n_active from poi_a group by 1,2", ("poi_a",))
def amenity_counts(v):
    g = v.poi_a().groupBy("aoi_id", "amenity").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("amenity").isin("clinic", "hospital"), 1)).alias("n_active"))
    return g.orderBy("aoi_id", F.desc("n"), "amenity")


@query("tier_counts", "select src, count(*) as n from (select 'a' as src from poi_a union all select 'b' from poi_b union all select 'union' from poi_a union all select 'union' from poi_b) group by 1", ("poi_a", "poi_b"))
def tier_counts(v):
    tag = lambda df, s: df.select(F.lit(s).alias("src"))
    both = tag(v.poi_a(), "a").unionByName(tag(v.poi_b(), "b"))
    n = both.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    return n.unionByName(n.select(F.lit("union").alias("src"), "n").groupBy("src").agg(F.sum("n").alias("n")))


@_near_q("analysis_facts", f""", tot as (select aoi_id, count(*) n, sum(weight) tw, sum(weight*dist_m) twd, max(dist_m) mx from nr group by 1), {_GINI}, g as (select aoi_id, round(greatest(0e0, least(1e0, 1e0-sum(w*(2e0*cwd-wd))/(max(tw)*max(twd)))), 3) as gini from c group by 1),
 e as (select aoi_id, dist_m, weight, sum(weight) over (partition by aoi_id order by dist_m desc, demand_id) cw, sum(weight) over (partition by aoi_id) tw from nr),
 b as (select aoi_id, sum(weight*dist_m)/sum(weight) bd from e where round(cw,6)<=round(0.1e0*tw,6) group by 1)
 select aoi_id, n as num_demand_points, round(tw,2) as total_demand_weight, round(twd/tw/1e3,3) as mean_km, gini, round(coalesce(bd,mx)/1e3,3) as bottom_decile_km, round(round(coalesce(bd,mx)/1e3,3)/(twd/tw/1e3),2) as bottom_vs_mean,
 (select count(*) from nr where nr.aoi_id=tot.aoi_id and dist_m>10000) as num_uncovered_points from tot join g using (aoi_id) left join b using (aoi_id)""")
def analysis_facts(n):
    rows = running.distribution(n, ["aoi_id"])
    mean_km = F.max("tot_wd") / F.max("tot_w") / 1e3
    g = rows.groupBy("aoi_id").agg(
        F.max("tot_n").alias("num_demand_points"), F.round(F.max("tot_w"), 2).alias("total_demand_weight"), mean_km.alias("_m"),
        F.round(running.gini_expr(), 3).alias("gini"), F.coalesce(F.sum(F.when(F.col("d") > R, F.col("n"))), F.lit(0).cast("bigint")).alias("num_uncovered_points"),
    )
    b = running.worst_served(n, ["aoi_id"], dist_rows=rows).withColumn("bottom_decile_km", F.round(F.col("bottom_decile_m") / 1e3, 3))
    return g.join(b, "aoi_id").select(
        "aoi_id", "num_demand_points", "total_demand_weight", F.round("_m", 3).alias("mean_km"), "gini", "bottom_decile_km",
        F.round(F.col("bottom_decile_km") / F.col("_m"), 2).alias("bottom_vs_mean"), "num_uncovered_points",
    )


_PIX = "cast(user_id%7 as int) as raster_id, cast(event_id%3 as int) as band, cast(event_id//97 as int) as row, cast(event_id%97 as int) as col, case when user_id%7=3 then 5e0 else value end as v"
_STRETCH = "case when hi > lo then floor((v-lo)/(hi-lo)*255e0) else 0 end"


@query("raster_band_stretch", f"with p as (select {_PIX} from events) select raster_id, band, maxrow-row as row, col, cast({_STRETCH} as int) as px from p join (select raster_id, band, min(v) lo, max(v) hi from p group by 1,2) using (raster_id, band) join (select raster_id, max(row) maxrow from p group by 1) using (raster_id)")
def raster_band_stretch(v):
    p = v.table("events").select(*[F.expr(e) for e in _PIX.replace("event_id//97", "event_id div 97").split(", ")])
    span = p.groupBy("raster_id", "band").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    top = p.groupBy("raster_id").agg(F.max("row").alias("maxrow"))
    return p.join(span, ["raster_id", "band"]).join(top, "raster_id").select(
        "raster_id", "band", (F.col("maxrow") - F.col("row")).alias("row"), "col", F.expr(f"cast({_STRETCH} as int)").alias("px")
    )


@query("sensitivity_ranking", "with s as (select *, case when s_suppkey%9<>0 then (s_acctbal-100e0)/100e0*100e0 end as deg from supplier) select s_nationkey, s_suppkey, deg, coalesce(s_suppkey = (select arg_max(s_suppkey, (deg, -s_suppkey)) from s q where q.s_nationkey=s.s_nationkey and deg is not null), false) as most_critical from s")
def sensitivity_ranking(v):
    """Sorted by degradation, unsolved rows last; the worst one per group is flagged."""
    deg = F.when(F.col("s_suppkey") % 9 != 0, degradation_pct(F.lit(100.0), F.col("s_acctbal"), F.lit(False)))
    s = v.table("supplier").withColumn("deg", deg)
    worst = s.where("deg is not null").groupBy("s_nationkey").agg(F.max(F.struct("deg", (-F.col("s_suppkey")).alias("i"))).alias("m"))
    worst = worst.select("s_nationkey", (-F.col("m.i")).alias("s_suppkey"), F.lit(True).alias("most_critical"))
    out = s.join(worst, ["s_nationkey", "s_suppkey"], "left").select("s_nationkey", "s_suppkey", "deg", F.coalesce("most_critical", F.lit(False)).alias("most_critical"))
    return out.orderBy("s_nationkey", F.desc_nulls_last("deg"), "s_suppkey")


@query("capped_sample")
def capped_sample(v):
    """At most 5000 features, always the same ones."""
    return v.demand().orderBy(F.xxhash64("demand_id"), "demand_id").limit(5000)


@query("payload_limits", "select demand_id, weight from demand order by weight desc, demand_id limit 500", ("demand",))
def payload_limits(v):
    return v.demand().orderBy(F.desc("weight"), "demand_id").limit(500).select("demand_id", "weight")


@query("provider_union", "select aoi_id, poi_id, name, amenity, 'a' as source from poi_a union all select aoi_id, poi_id, name, null, 'b' from poi_b", ("poi_a", "poi_b"))
def provider_union(v):
    a = v.poi_a().select("aoi_id", "poi_id", "name", "amenity", F.lit("a").alias("source"))
    b = v.poi_b().select("aoi_id", "poi_id", "name", F.lit("b").alias("source"))
    return a.unionByName(b, allowMissingColumns=True)


@query("must_open_closed", """with o as (select aoi_id, site_id from candidates where site_id%5=0 union select aoi_id, site_id from candidates where site_id%7=0), c as (select aoi_id, site_id from candidates where site_id%11=0)
 select aoi_id, site_id, 'open' as kind from o union all select aoi_id, site_id, 'conflict' from (select * from o intersect select * from c)""", ("candidates",))
def must_open_closed(v):
    c = v.candidates().select("aoi_id", "site_id")
    opened = c.where("site_id % 5 = 0").union(c.where("site_id % 7 = 0")).distinct()
    clash = opened.intersect(c.where("site_id % 11 = 0"))
    return opened.withColumn("kind", F.lit("open")).unionByName(clash.withColumn("kind", F.lit("conflict")))


@query("newly_uncovered", f"""with b as (select distinct d.aoi_id, d.demand_id, d.weight from demand d join candidates c on c.aoi_id=d.aoi_id and {hav('d', 'c')} <= 10000),
 p as (select distinct d.aoi_id, d.demand_id from demand d join (select * from candidates where site_id%4<>0) c on c.aoi_id=d.aoi_id and {hav('d', 'c')} <= 10000)
 select aoi_id, count(*) as n_lost, round(sum(weight),4) as lost_weight from b where demand_id not in (select demand_id from p) group by 1""", DC)
def newly_uncovered(v):
    d, c = v.demand(), v.candidates()
    base = nearest_site(d, c, max_m=R).where("site_id is not null")
    left = nearest_site(d, c.where("site_id % 4 <> 0"), max_m=R).where("site_id is not null")
    lost = base.join(left.select("aoi_id", "demand_id"), ["aoi_id", "demand_id"], "left_anti")
    return lost.groupBy("aoi_id").agg(F.count(F.lit(1)).alias("n_lost"), F.round(F.sum("weight"), 4).alias("lost_weight"))


@query("drop_one_candidates", "with " + ", ".join([OD] + _greedy_parts(3)) + """, s as (select aoi_id, site_id from p1 union all select aoi_id, site_id from p2 union all select aoi_id, site_id from p3)
 select aoi_id, s.site_id as dropped, c.site_id from s join candidates c using (aoi_id) where c.site_id <> s.site_id""", DC)
def drop_one_candidates(v):
    """What is left to choose from once each site of a solution is taken away in turn."""
    c = v.candidates()
    sel = pmedian.p_median_greedy(v.demand(), c, 3).select("aoi_id", F.col("site_id").alias("dropped"))
    return c.select("aoi_id", "site_id").join(sel, "aoi_id").where("site_id <> dropped").select("aoi_id", "dropped", "site_id")


@_near_q("access_surface", "select aoi_id, demand_id, lon, lat, weight, dist_m, dist_m > 10000 as is_gap from nr")
def access_surface(n):
    return n.select("aoi_id", "demand_id", "lon", "lat", "weight", "dist_m", (F.col("dist_m") > R).alias("is_gap"))


@query("coverage_rings", """select aoi_id, site_id, seq, round(lon+degrees(atan2(sin(radians(b))*sin(d)*cos(radians(lat)), cos(d)-sin(radians(lat))*sin(p2))),6) as lon, round(degrees(p2),6) as lat
 from (select *, asin(sin(radians(lat))*cos(d)+cos(radians(lat))*sin(d)*cos(radians(b))) as p2 from (select aoi_id, site_id, lon, lat, i as seq, i*15e0 as b, 10000e0/6371008.8e0 as d from candidates, (select unnest(range(25)) as i)))""", ("candidates",))
def coverage_rings(v):
    c = v.candidates().select("aoi_id", "site_id", "lon", "lat", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(24).cast("bigint"))).alias("seq"))
    x, y = geo.destination(F.col("lon"), F.col("lat"), F.col("seq") * 15.0, R)
    return c.select("aoi_id", "site_id", "seq", F.round(x, 6).alias("lon"), F.round(y, 6).alias("lat"))


@query("dataset_catalog", """select dataset, role, n_rows, x0, x1, round(mean_w, 6) as mean_w from (select 'demand_points' as dataset, 'demand' as role, count(*) n_rows, min(lon) x0, max(lon) x1, avg(weight) mean_w from demand
 union all select 'candidate_sites', 'candidate', count(*), min(lon), max(lon), avg(capacity) from candidates union all select 'boundary_all', 'boundary', count(*), min(x1), max(x1), null from boundary_edges)""", ("demand", "candidates", "boundary_edges"))
def dataset_catalog(v):
    from ..sources.catalog import dataset_role

    def one(df, name, x, w):
        return df.agg(F.count(F.lit(1)).alias("n_rows"), F.min(x).alias("x0"), F.max(x).alias("x1"), F.round(F.avg(w), 6).alias("mean_w")).withColumn("dataset", F.lit(name))

    parts = [one(v.demand(), "demand_points", "lon", F.col("weight")), one(v.candidates(), "candidate_sites", "lon", F.col("capacity")),
             one(v.boundary_edges(), "boundary_all", "x1", F.lit(None).cast("double"))]
    u = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return u.select("dataset", dataset_role(F.col("dataset")).alias("role"), "n_rows", "x0", "x1", "mean_w")


@query("metric_choice", """select aoi_id, round(a*(1+r*3),1) as area_km2, case when a*(1+r*3) > 10000 then 'geodesic' else 'network' end as metric, case when a*(1+r*3) > 10000 then 'area above limit' end as reason
 from (select aoi_id, abs(sum(radians(x1)*6371008.8e0*sin(radians(y2))*6371008.8e0 - radians(x2)*6371008.8e0*sin(radians(y1))*6371008.8e0))/2e0/1e6 as a, cast(substr(aoi_id,2) as int) as r from boundary_edges group by 1)""", ("boundary_edges",))
def metric_choice(v):
    a = measures.polygon_area(v.boundary_edges()).withColumn("area_km2", F.col("area_km2") * (1 + F.substring("aoi_id", 2, 9).cast("int") * 3))
    big = F.col("area_km2") > 10000
    return a.select("aoi_id", F.round("area_km2", 1).alias("area_km2"), F.when(big, "geodesic").otherwise("network").alias("metric"), F.when(big, "area above limit").alias("reason"))


@query("scale_match", """with b as (select aoi_id, (max(x1)-min(x1))*(max(y1)-min(y1))*power(10e0, 2*cast(substr(aoi_id,2) as int)-4) as a from boundary_edges group by 1), s(scale, ord, lo, hi) as (values ('country',1,10e0,1e308),('region',2,0.5e0,50e0),('city',3,0.01e0,5e0),('neighborhood',4,0.0001e0,0.5e0))
 select aoi_id, round(a,9) as area_deg2, a between 0.01e0 and 5e0 as plausible, a > 500e0 or a < 0.0001e0 as hard_reject, case when not (a between 0.01e0 and 5e0) then (select arg_min(scale, ord) from s where a between lo and hi and scale<>'city') end as suggests from b""", ("boundary_edges",))
def scale_match(v):
    b = v.boundary_edges().groupBy("aoi_id").agg(((F.max("x1") - F.min("x1")) * (F.max("y1") - F.min("y1"))).alias("a"))
    b = b.withColumn("a", F.col("a") * F.pow(F.lit(10.0), 2 * F.substring("aoi_id", 2, 9).cast("int") - 4)).withColumn("scale", F.lit("city"))
    lo, hi = scale.area_range(F.col("scale"))
    ok = F.col("a").between(lo, hi)
    other = F.coalesce(*[F.when(F.col("a").between(r[2], r[3]) & (F.col("scale") != n), F.lit(n)) for n, r in scale.SCALES.items()])
    return b.select("aoi_id", F.round("a", 9).alias("area_deg2"), ok.alias("plausible"), ((F.col("a") > hi * 100) | (F.col("a") < lo / 100)).alias("hard_reject"), F.when(~ok, other).alias("suggests"))
