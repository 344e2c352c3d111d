"""Queries over the nearest-site relation."""

from ..plans import audit
from .joins import ROAD_PATHS, SNAP
from .registry import NEAREST_SQL, hav, query

RADIUS_M = 10000.0

NEAR = "with nr as (" + NEAREST_SQL + ")"


AUDIT_SQL = """,
tot as (select aoi_id, sum(weight) tw, sum(weight*dist_m) twd, count(*) n from nr group by 1),
cum as (select nr.*, sum(weight) over (partition by aoi_id order by dist_m desc, demand_id) cw,
   sum(weight*dist_m) over (partition by aoi_id order by dist_m, demand_id) cwd,
   row_number() over (partition by aoi_id order by dist_m desc, demand_id) rk from nr),
g as (select aoi_id, 1e0 - sum(weight*(2e0*cwd - weight*dist_m))/(max(tw)*max(twd)) as g from cum join tot using (aoi_id) group by 1),
dec as (select aoi_id, sum(weight*dist_m)/sum(weight) as bd from cum join tot using (aoi_id)
   where round(cw,6) <= round(0.1e0*tw,6) group by 1),
worst as (select aoi_id, string_agg(cast(demand_id as varchar), ',' order by rk) as worst_points from cum where rk<=10 group by 1),
ns as (select aoi_id, count(*) nf from candidates group by 1),
area as (select aoi_id, abs(sum(radians(x1)*6371008.8e0*sin(radians(y2))*6371008.8e0 - radians(x2)*6371008.8e0*sin(radians(y1))*6371008.8e0))/2e0/1e6 as a from boundary_edges group by 1),
base as (select aoi_id, count(*) n_demand,
   round(sum(case when dist_m<=10000 then weight else 0 end)/sum(weight)*100e0,6) pct_weight_covered,
   round(sum(case when dist_m<=10000 then 1 else 0 end)/count(*)*100e0,6) pct_points_covered,
   round(sum(weight)-sum(case when dist_m<=10000 then weight else 0 end),4) uncovered_weight,
   round(sum(weight*dist_m)/sum(weight),3) avg_distance_m, max(dist_m) max_distance_m,
   round(quantile_cont(dist_m,0.9),3) p90_distance_m, max(dist_m) mx from nr group by 1),
dm as (select aoi_id, count(*) as dn, sum(weight) as dw from demand group by 1)
select aoi_id, coalesce(n_demand, dn) as n_demand, coalesce(nf, 0) as n_facilities, coalesce(pct_weight_covered, 0e0) as pct_weight_covered,
  coalesce(pct_points_covered, 0e0) as pct_points_covered, coalesce(uncovered_weight, round(dw, 4)) as uncovered_weight, avg_distance_m,
  max_distance_m, p90_distance_m, case when mx is not null then round(greatest(0e0,least(1e0,g)),6) end as gini, round(coalesce(bd, mx),3) as bottom_decile_m,
  round(coalesce(nf,0)/a,9) as facilities_per_km2, round(coalesce(nf,0)/coalesce(tw,dw)*1000e0,9) as facilities_per_1000, worst_points
from dm left join base using (aoi_id) left join tot using (aoi_id) left join g using (aoi_id) left join dec using (aoi_id) left join worst using (aoi_id) left join ns using (aoi_id) left join area using (aoi_id)
"""


@query("analyze_facilities", NEAR + AUDIT_SQL, ("demand", "candidates", "boundary_edges"))
def analyze_facilities(v):
    return audit.analyze_facilities(v.demand(), v.candidates(), RADIUS_M, v.boundary_edges())


#: Nearest candidate by road within 50 km; else by straight line.
NEAR_ROAD = f"""with sn as ({SNAP.format(id="site_id", t="candidates", o="s_node", h=hav("p", "n"))}),
dn as ({SNAP.format(id="demand_id", t="demand", o="d_node", h=hav("p", "n"))}), {ROAD_PATHS},
reached as (select dn.aoi_id, dn.demand_id, min(p.dist) as dist_m, arg_min(s.site_id, (p.dist, s.site_id)) as site_id from dn
  join path p on p.aoi_id=dn.aoi_id and p.node=dn.d_node join sn s on s.aoi_id=p.aoi_id and s.s_node=p.source where p.dist <= 50000 group by 1, 2),
lines as ({NEAREST_SQL}),
nr as (select l.aoi_id, l.demand_id, l.lon, l.lat, l.weight, coalesce(r.dist_m, l.dist_m) as dist_m, coalesce(r.site_id, l.site_id) as site_id,
  r.dist_m is null as off from lines l left join reached r using (aoi_id, demand_id))"""


@query("analyze_facilities_network", NEAR_ROAD + ", audit as (" + AUDIT_SQL.strip().replace("tot as", "with tot as", 1).lstrip(",\n") + """)
select audit.*, (select count(*) from nr where nr.aoi_id = audit.aoi_id and off) as n_off_road from audit""",
       ("demand", "candidates", "boundary_edges", "road_nodes", "road_edges"), recursive=True)
def analyze_facilities_network(v):
    return audit.analyze_facilities_network(v.demand(), v.candidates(), RADIUS_M, v.road_nodes(), v.road_edges(), v.boundary_edges())
