"""Distance, coverage, containment and merge joins."""

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import coverage, dedup, network, polygon
from ..operators.nearest import nearest_site
from .registry import NEAREST_SQL, hav, query

DC = ("demand", "candidates")
R = 10000.0


@query("od_haversine", f"select * from (select aoi_id, demand_id, site_id, {hav('d', 'c')} as dist_m from demand d join candidates c using (aoi_id)) where dist_m <= 20000", DC)
def od_haversine(v):
    return coverage.coverage_pairs(v.demand(), v.candidates(), 20000.0)


@query("od_geodesic")
def od_geodesic(v):
    return coverage.geodesic_pairs(v.demand(), v.candidates(), 20000.0)


def _mercator(df):
    x, y = geo.web_mercator(F.col("lon"), F.col("lat"))
    return df.withColumn("_x", x).withColumn("_y", y).withColumn("lon", F.col("_x")).withColumn("lat", F.col("_y")).drop("_x", "_y")


_XY = "select *, radians(lon)*6378137e0 as x, ln(tan(pi()/4+radians(lat)/2e0))*6378137e0 as y from "
_PLANAR = "select aoi_id, demand_id, site_id, dist_m from (select d.aoi_id, demand_id, site_id, floor({e}*1000e0+0.5e0)/1000e0 as dist_m from (" + _XY + "demand) d join (" + _XY + "candidates) c on d.aoi_id=c.aoi_id) where dist_m <= 20000"


@query("od_euclidean", _PLANAR.format(e="sqrt((c.x-d.x)*(c.x-d.x)+(c.y-d.y)*(c.y-d.y))"), DC)
def od_euclidean(v):
    return coverage.coverage_pairs(_mercator(v.demand()), _mercator(v.candidates()), 20000.0, metric=geo.Planar)


@query("od_manhattan", _PLANAR.format(e="(abs(c.x-d.x)+abs(c.y-d.y))"), DC)
def od_manhattan(v):
    # the range join filters in plain x, y
    return _city_block(_mercator(v.demand()), _mercator(v.candidates()))


def _city_block(d, s, radius=20000.0, digits=None):
    # a distance that rounds to the radius is still within it
    wide = radius if digits is None else radius + 10.0**-digits
    p = coverage.pairs_within(d.select("aoi_id", "demand_id", "lon", "lat"), s.select("aoi_id", "site_id", "lon", "lat"), wide, metric=geo.Planar, exact=False)
    dist = geo.manhattan(F.col("lon"), F.col("lat"), F.col("site_x"), F.col("site_y"))
    dist = geo.mm(dist) if digits is None else F.round(dist, digits)
    return p.withColumn("dist_m", dist).where(F.col("dist_m") <= radius).select("aoi_id", "demand_id", "site_id", "dist_m")


_AZ = """select t.*, k*cos(radians(lat))*sin(radians(lon)-radians(clon))*6371008.8e0 as x,
 k*(cos(radians(clat))*sin(radians(lat))-sin(radians(clat))*cos(radians(lat))*cos(radians(lon)-radians(clon)))*6371008.8e0 as y
 from (select *, case when abs(c)<1e-12 then 1e0 else c/sin(c) end as k from (select *, 2e0*asin(least(1e0, sqrt(sin((radians(lat)-radians(clat))/2e0)*sin((radians(lat)-radians(clat))/2e0)+cos(radians(clat))*cos(radians(lat))*(sin((radians(lon)-radians(clon))/2e0)*sin((radians(lon)-radians(clon))/2e0))))) as c from {t} join ctr using (aoi_id))) t"""


@query("od_manhattan_geo", "with ctr as (select aoi_id, round(avg(lon), 9) as clon, round(avg(lat), 9) as clat from (select aoi_id, lon, lat from demand union all select aoi_id, lon, lat from candidates) group by 1), dd as ("
       + _AZ.format(t="demand") + "), cc as (" + _AZ.format(t="candidates") + ") select aoi_id, demand_id, site_id, dist_m from (select d.aoi_id, demand_id, site_id, round(abs(d.x-c.x)+abs(d.y-c.y), 2) as dist_m from dd d join cc c on d.aoi_id=c.aoi_id) where dist_m <= 20000", DC)
def od_manhattan_geo(v):
    d, c = v.demand(), v.candidates()
    both = d.select("aoi_id", "lon", "lat").unionByName(c.select("aoi_id", "lon", "lat"))
    ctr = both.groupBy("aoi_id").agg(F.round(F.avg("lon"), 9).alias("clon"), F.round(F.avg("lat"), 9).alias("clat"))

    def flat(df):
        j = df.join(ctr, "aoi_id")
        x, y = geo.azimuthal(F.col("lon"), F.col("lat"), F.col("clon"), F.col("clat"))
        return j.withColumn("_x", x).withColumn("_y", y).drop("lon", "lat").withColumnsRenamed({"_x": "lon", "_y": "lat"})

    return _city_block(flat(d), flat(c), digits=2)


ROAD_PATHS = """path(aoi_id, source, node, dist) using key (aoi_id, source, node) as (
 select distinct aoi_id, s_node, s_node, 0e0 from sn
 union
 select p.aoi_id, p.source, e.dst, min(p.dist+e.length_m) from path p join road_edges e on e.aoi_id=p.aoi_id and e.src=p.node
  left join recurring.path r on r.aoi_id=p.aoi_id and r.source=p.source and r.node=e.dst
  where r.dist is null or p.dist+e.length_m < r.dist group by 1, 2, 3)"""
SNAP = "select p.aoi_id, p.{id}, p.lon, p.lat, arg_min(n.node_id, ({h}, n.node_id)) as {o} from {t} p join road_nodes n using (aoi_id) group by all"


@query("od_network", "with sn as (" + SNAP.format(id="site_id", t="candidates", o="s_node", h=hav("p", "n")) + "), dn as ("
       + SNAP.format(id="demand_id", t="demand", o="d_node", h=hav("p", "n")) + "), " + ROAD_PATHS
       + f""" select q.aoi_id, demand_id, site_id, coalesce(dist, g) as dist_m, dist is not null as on_road from
 (select d.aoi_id, demand_id, site_id, d_node, s_node, {hav('d', 's')} as g from dn d join sn s on d.aoi_id=s.aoi_id) q
 left join path p on p.aoi_id=q.aoi_id and p.source=q.s_node and p.node=q.d_node where g <= 10000""",
       ("demand", "candidates", "road_nodes", "road_edges"), recursive=True)
def od_network(v):
    return network.network_pairs(v.demand(), v.candidates(), v.road_nodes(), v.road_edges(), R).select(
        "aoi_id", "demand_id", "site_id", "dist_m", "on_road"
    )


@query("coverage_pairs", f"select * from (select aoi_id, demand_id, site_id, {hav('d', 'c')} as dist_m from demand d join candidates c using (aoi_id)) where dist_m <= 5000", DC)
def coverage_pairs(v):
    return coverage.coverage_pairs(v.demand(), v.candidates(), 5000.0)


@query("nearest_facility", "select aoi_id, demand_id, site_id, dist_m from (" + NEAREST_SQL + ")", DC)
def nearest_facility(v):
    return nearest_site(v.demand(), v.candidates()).select("aoi_id", "demand_id", "site_id", "dist_m")


@query("snap_to_node", f"select d.aoi_id, d.demand_id, arg_min(n.node_id, ({hav('d', 'n')}, n.node_id)) as node_id, min({hav('d', 'n')}) as snap_m from demand d join road_nodes n using (aoi_id) group by all",
       ("demand", "road_nodes"))
def snap_to_node(v):
    return nearest_site(v.demand().select("aoi_id", "demand_id", "lon", "lat"), v.road_nodes(), site_id="node_id", id_name="node_id", dist_name="snap_m").select(
        "aoi_id", "demand_id", "node_id", "snap_m"
    )


# a fixed rule stands for a solution: every third site is open
_OPEN = "site_id % 3 = 0"
_SEL = f"candidates where {_OPEN}"


@query("nearest_covering", f"""select aoi_id, demand_id, case when dist_m <= 10000 then site_id end as site_id, case when dist_m <= 10000 then dist_m end as dist_m from
 (select d.aoi_id, d.demand_id, min({hav('d', 'c')}) as dist_m, arg_min(c.site_id, ({hav('d', 'c')}, c.site_id)) as site_id from demand d left join (select * from {_SEL}) c using (aoi_id) group by all)""", DC)
def nearest_covering(v):
    return nearest_site(v.demand(), v.candidates().where(_OPEN), max_m=R).select("aoi_id", "demand_id", "site_id", "dist_m")


@query("assigned_distance", f"""select d.aoi_id, d.demand_id, coalesce(max(case when a.site_id = c.site_id then {hav('d', 'c')} end), min({hav('d', 'c')})) as dist_m
 from demand d join (select * from {_SEL}) c using (aoi_id) left join (select aoi_id as a_aoi, demand_id as a_dem, site_id from demand join (select aoi_id, max(site_id) as site_id from {_SEL} group by 1) using (aoi_id) where demand_id%5<>0) a
  on a.a_dem = d.demand_id and a.a_aoi = d.aoi_id group by d.aoi_id, d.demand_id""", DC)
def assigned_distance(v):
    d, s = v.demand(), v.candidates().where(_OPEN)
    plan = d.where("demand_id % 5 <> 0").join(s.groupBy("aoi_id").agg(F.max("site_id").alias("given")), "aoi_id").select("aoi_id", "demand_id", "given")
    near = nearest_site(d.select("aoi_id", "demand_id", "lon", "lat"), s).join(plan, ["aoi_id", "demand_id"], "left")
    xy = s.select("aoi_id", F.col("site_id").alias("given"), F.col("lon").alias("sx"), F.col("lat").alias("sy"))
    own = geo.Haversine.dist(F.col("lon"), F.col("lat"), F.col("sx"), F.col("sy"))
    return near.where("dist_m is not null").join(xy, ["aoi_id", "given"], "left").select(
        "aoi_id", "demand_id", F.coalesce(own, F.col("dist_m")).alias("dist_m")
    )


_INSIDE = ("(select d.{id} from {t} d join boundary_edges e on d.aoi_id=e.aoi_id and (e.y1>d.lat)<>(e.y2>d.lat) "
           "and e.x1+(d.lat-e.y1)/(e.y2-e.y1)*(e.x2-e.x1) > d.lon group by 1 having count(*)%2=1)")


@query("point_in_polygon", """select d.demand_id, e.aoi_id as poly from demand d join boundary_edges e on (e.y1>d.lat)<>(e.y2>d.lat)
 and e.x1+(d.lat-e.y1)/(e.y2-e.y1)*(e.x2-e.x1) > d.lon group by 1, 2 having count(*)%2=1""", ("demand", "boundary_edges"))
def point_in_polygon(v):
    e = v.boundary_edges().withColumnRenamed("aoi_id", "poly")
    return polygon.points_in_polygons(v.demand(), e, ["demand_id"], ["poly"])


@query("clip_to_boundary", "select aoi_id, poi_id, name from poi_a where poi_id in " + _INSIDE.format(id="poi_id", t="poi_a"), ("poi_a", "boundary_edges"))
def clip_to_boundary(v):
    return polygon.clip_to_own_polygon(v.poi_a(), v.boundary_edges(), "poi_id").select("aoi_id", "poi_id", "name")


@query("self_intersection_flag", """select aoi_id, kind, kind = 'bow' as self_intersects from (select distinct aoi_id from boundary_edges), (values ('ring'), ('bow')) t(kind)""", ("boundary_edges",))
def self_intersection_flag(v):
    ring = v.boundary_edges().withColumn("kind", F.lit("ring"))
    # the same ring with its second and third corner exchanged crosses itself
    b = v.boundaries()
    pts = [(0.05, 0.05), (0.75, 0.55), (0.75, 0.05), (0.05, 0.55)]
    rows = [F.struct(F.lit(i).alias("seq"), *[F.lit(c).alias(n) for n, c in zip("abcd", pts[i] + pts[(i + 1) % 4])]) for i in range(4)]
    e = b.select("aoi_id", "ox", "oy", F.explode(F.array(*rows)).alias("e"))
    bow = e.select("aoi_id", F.col("e.seq").alias("seq"), (F.col("ox") + F.col("e.a")).alias("x1"), (F.col("oy") + F.col("e.b")).alias("y1"),
                   (F.col("ox") + F.col("e.c")).alias("x2"), (F.col("oy") + F.col("e.d")).alias("y2"), F.lit("bow").alias("kind"))
    return polygon.self_crossings(ring.unionByName(bow), ("aoi_id", "kind"))


@query("dedup_providers", f"""with m as (select b.aoi_id, b.poi_id, b.name, b.amenity, b.lon, b.lat, arg_min(a.poi_id, ({hav('b', 'a')}, a.poi_id)) as left_id, arg_min(a.name, ({hav('b', 'a')}, a.poi_id)) as left_name, min({hav('b', 'a')}) as dist
 from poi_b b join poi_a a using (aoi_id) group by all),
 t as (select *, list_distinct(regexp_extract_all(lower(name), '[a-z0-9]+')) ta, list_distinct(regexp_extract_all(lower(left_name), '[a-z0-9]+')) tb from m),
 j as (select *, dist <= 50 and (len(ta)=0 or len(tb)=0 or 2*len(list_intersect(ta,tb)) >= len(list_distinct(list_concat(ta,tb)))) as same from t)
 select aoi_id, poi_id, name, case when poi_id in (select left_id from j where same) then 'a,b' else 'a' end as sources from poi_a
 union all select aoi_id, poi_id, name, 'b' from j where not same""", ("poi_a", "poi_b"))
def dedup_providers(v):
    a = v.poi_a().withColumn("sources", F.array(F.lit("a")))
    b = v.poi_b().withColumn("sources", F.array(F.lit("b")))
    m = dedup.merge_providers(a, b)
    return m.select("aoi_id", "poi_id", "name", F.array_join("sources", ",").alias("sources"))


_EXIST = "site_id % 5 = 0"


@query("residual_demand", f"""select aoi_id, count(*) filter (dist_m <= 10000) as n_served, coalesce(round(sum(weight) filter (dist_m <= 10000), 4), 0e0) as served_weight,
  count(*) filter (dist_m is null or dist_m > 10000) as n_left, round(avg(dist_m), 3) as mean_nearest_m from
 (select d.aoi_id, d.demand_id, d.weight, min(case when c.site_id is not null then {hav('d', 'c')} end) as dist_m from demand d left join (select * from candidates where {_EXIST}) c using (aoi_id) group by all) group by 1""", DC)
def residual_demand(v):
    n = nearest_site(v.demand(), v.candidates().where(_EXIST))
    served = F.coalesce(F.col("dist_m") <= R, F.lit(False))
    return n.groupBy("aoi_id").agg(
        F.count(F.when(served, 1)).alias("n_served"),
        F.coalesce(F.round(F.sum(F.when(served, F.col("weight"))), 4), F.lit(0.0)).alias("served_weight"),
        F.count(F.when(~served, 1)).alias("n_left"),
        F.round(F.avg("dist_m"), 3).alias("mean_nearest_m"),
    )


@query("max_distance_mask", f"""select aoi_id, demand_id from demand where demand_id not in (select demand_id from demand d join candidates c using (aoi_id) where {hav('d', 'c')} <= 15000)""", DC)
def max_distance_mask(v):
    n = nearest_site(v.demand().select("aoi_id", "demand_id", "lon", "lat"), v.candidates(), max_m=15000.0)
    return n.where("site_id is null").select("aoi_id", "demand_id")


@query("uncoverable_points", f"""select d.aoi_id, d.demand_id, count(c.site_id) as n_sites from demand d left join candidates c on c.aoi_id=d.aoi_id and {hav('d', 'c')} <= 10000 group by all having count(c.site_id) < 2""", DC)
def uncoverable_points(v):
    return coverage.cover_counts(v.demand(), v.candidates(), R).where("n_sites < 2").select("aoi_id", "demand_id", "n_sites")
