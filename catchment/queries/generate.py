"""Generated points, thinning, hulls and areas from datasets."""

from pyspark.sql import functions as F

from ..functions.scale import n_points_from_area
from ..operators import hull, measures
from ..operators.polygon import clip_to_own_polygon
from ..plans import generate
from ..session import materialize
from .registry import query


def _counts(v):
    a = measures.polygon_area(v.boundary_edges())
    return a.select("aoi_id", n_points_from_area(F.col("area_km2")).alias("n"), generate.estimate_population(F.lit(None).cast("string"), F.col("area_km2")).alias("population"))


@query("synthetic_demand", """select aoi_id, n as n_points, cast(floor(a*250e0) as double) as total, 'synthetic_uniform_grid' as data_source from (select aoi_id, a, greatest(50, least(2000, cast(floor(sqrt(a)*8) as bigint))) as n
 from (select aoi_id, abs(sum(radians(x1)*6371008.8e0*sin(radians(y2))*6371008.8e0 - radians(x2)*6371008.8e0*sin(radians(y1))*6371008.8e0))/2e0/1e6 as a from boundary_edges group by 1))""", ("boundary_edges",))
def synthetic_demand(v):
    """All points drawn, summed up per area: as many as asked for, sharing the population."""
    c = _counts(v)
    d = generate.synthetic_demand(c.select("aoi_id", "n"), v.boundary_edges(), c.select("aoi_id", "population"))
    return d.groupBy("aoi_id", "data_source").agg(F.count(F.lit(1)).alias("n_points"), F.round(F.sum("weight"), 3).alias("total")).select("aoi_id", "n_points", "total", "data_source")


@query("synthetic_candidates")
def synthetic_candidates(v):
    """Points in the hull of the demand, latitudes uniform by area."""
    h = hull_edges(hull.convex_hull(v.demand()))
    n = v.candidates().groupBy("aoi_id").agg(F.count(F.lit(1)).alias("n"))
    p = generate.points_in_areas(n, h, sphere=True)
    return p.select("aoi_id", F.col("point_no").alias("site_id"), "lon", "lat", F.lit(True).alias("is_synthetic"))


@query("synthetic_status", """select aoi_id, n, case when a > 0 then 'ok' else 'no extent' end as status from (select aoi_id, count(*) as n from demand group by 1)
 join (select aoi_id, abs(sum(x1*y2 - x2*y1)) as a from boundary_edges group by 1) using (aoi_id) union all select 'none', 1, 'no boundary'""", ("demand", "boundary_edges"))
def synthetic_status(v):
    """Which areas points can be drawn in, one of them unknown."""
    n = v.demand().groupBy("aoi_id").agg(F.count(F.lit(1)).alias("n"))
    none = n.select(F.lit("none").alias("aoi_id"), F.lit(1).cast("bigint").alias("n")).limit(1)
    return generate.draw_status(n.unionByName(none), v.boundary_edges())


def hull_edges(h):
    """Closed ring edges from ordered hull corners."""
    h = materialize(h, "hull")
    n = h.groupBy("aoi_id").agg(F.count(F.lit(1)).alias("n"))
    nxt = h.select("aoi_id", F.col("seq").alias("_s"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    e = h.join(n, "aoi_id").withColumn("_s", (F.col("seq") + 1) % F.col("n"))
    return e.join(nxt, ["aoi_id", "_s"]).select("aoi_id", "seq", F.col("x").alias("x1"), F.col("y").alias("y1"), "x2", "y2")


@query("convex_hull", """with p as (select distinct aoi_id, lon as x, lat as y from demand), nx as (select aoi_id, x, y from p)
 select a.aoi_id, a.x, a.y from p a where exists (select 1 from p b where b.aoi_id=a.aoi_id and (b.x<>a.x or b.y<>a.y) and not exists (select 1 from p c where c.aoi_id=a.aoi_id and (b.x-a.x)*(c.y-a.y)-(b.y-a.y)*(c.x-a.x) < 0))""", ("demand",))
def convex_hull(v):
    return hull.convex_hull(v.demand()).select("aoi_id", "x", "y")


@query("aoi_from_dataset")
def aoi_from_dataset(v):
    """Hull of the demand, every corner pushed out by the larger of 5 % of the extent and 500 m."""
    return generate.padded_outline(hull.convex_hull(v.demand()))


@query("thin_points")
def thin_points(v):
    return generate.thin_points(v.candidates(), 10)


@query("road_node_candidates")
def road_node_candidates(v):
    inside = clip_to_own_polygon(v.road_nodes(), v.boundary_edges(), "node_id")
    return generate.thin_points(inside, 500, point_id="node_id")
