"""Source queries: payload columns are derived from the driver tables."""

from pyspark.sql import functions as F

from ..functions import sql
from ..location.common import spread
from ..session import materialize, new_path
from ..sources import datasource, readers, wkb
from .registry import query


@query("read_points_csv", "select demand_id as cast_id, cast(floor(lon*1e6) as double)/1e6 as lon, cast(floor(lat*1e6) as double)/1e6 as lat from demand where demand_id%13<>0 and demand_id%17<>0", ("demand",))
def read_points_csv(v):
    d = v.demand().selectExpr("demand_id", "case when demand_id%13=0 then 'n/a' else cast(cast(floor(lon*1e6) as double)/1e6 as string) end as Longitude",
                              "case when demand_id%17=0 then '' else cast(cast(floor(lat*1e6) as double)/1e6 as string) end as LAT")
    path = new_path(v.spark, "csv")
    d.write.option("header", True).csv(path)
    pts, _ = readers.read_points_csv(v.spark, path)
    return pts.select(F.col("demand_id").cast("bigint").alias("cast_id"), "lon", "lat")


_PT = "concat('[', cast(c_custkey%170 as string), '.5,', cast(c_custkey%80 as string), '.25]')"
_FEAT = f"concat('{{\"type\":\"Feature\",\"properties\":{{\"demand\":\"', cast(c_custkey%100 as string), '\"}},\"geometry\":{{\"type\":\"Point\",\"coordinates\":', {_PT}, '}}}}')"
_GEO = (f"case c_custkey%3 when 0 then concat('{{\"type\":\"FeatureCollection\",\"crs\":{{\"properties\":{{\"name\":\"EPSG:3857\"}}}},\"features\":[', {_FEAT}, ',', {_FEAT}, ']}}') "
        f"when 1 then {_FEAT} else concat('{{\"type\":\"Point\",\"coordinates\":', {_PT}, '}}') end")


@query("read_geojson", """select c_custkey, feature_no, 'Point' as kind, c_custkey%170+0.5e0 as lon, c_custkey%80+0.25e0 as lat, case when c_custkey%3=0 then 'EPSG:3857' else 'EPSG:4326' end as crs,
 case when c_custkey%3<2 then cast(c_custkey%100 as varchar) end as demand from customer, (values (0),(1)) f(feature_no) where feature_no=0 or c_custkey%3=0""")
def read_geojson(v):
    docs = v.table("customer").select("c_custkey", F.expr(_GEO).alias("doc"))
    g = readers.parse_geojson(docs, "doc", ["c_custkey"])
    return g.select("c_custkey", "feature_no", "kind", "lon", "lat", "crs", F.col("properties")["demand"].alias("demand"))


@query("decode_wkb", "select aoi_id, demand_id, 0 as ring_no, 0 as seq, lon as x1, lat as y1, lon as x2, lat as y2 from demand union all select aoi_id, -1, 0, seq, x1, y1, x2, y2 from boundary_edges", ("demand", "boundary_edges"))
def decode_wkb(v):
    pts = v.demand().select("aoi_id", "demand_id", wkb.point_wkb("lon", "lat").alias("wkb"))
    ring = v.boundary_edges().groupBy("aoi_id").agg(F.array_sort(F.collect_list(F.struct("seq", F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")).alias("p")))).alias("r"))
    ring = ring.select("aoi_id", F.transform("r", lambda s: s["p"]).alias("r")).select("aoi_id", F.lit(-1).cast("bigint").alias("demand_id"), wkb.ring_wkb(F.concat("r", F.slice("r", 1, 1))).alias("wkb"))
    return wkb.decode_edges(pts.unionByName(ring), "wkb", ["aoi_id", "demand_id"])


@query("wkb_to_edges", "select aoi_id, 0 as ring_no, seq, x1, y1, x2, y2 from boundary_edges union all select concat(aoi_id, ':', demand_id), 0, 0, lon, lat, lon, lat from demand", ("demand", "boundary_edges"))
def wkb_to_edges(v):
    """Edges of geometries by a lateral join in SQL text."""
    sql.register(v.spark)
    ring = v.boundary_edges().groupBy("aoi_id").agg(F.array_sort(F.collect_list(F.struct("seq", F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")).alias("p")))).alias("r"))
    ring = ring.select("aoi_id", F.transform("r", lambda s: s["p"]).alias("r")).select("aoi_id", wkb.ring_wkb(F.concat("r", F.slice("r", 1, 1))).alias("wkb"))
    pts = v.demand().select(F.concat_ws(":", "aoi_id", F.col("demand_id").cast("string")).alias("aoi_id"), wkb.point_wkb("lon", "lat").alias("wkb"))
    return v.spark.sql("select g.aoi_id, e.* from {g} g, lateral wkb_to_edges(g.wkb) e", g=spread(ring.unionByName(pts), "aoi_id"))


_PX, _PY = "cast(c_custkey%160 as double)", "cast(c_custkey%80 as double)"
_CAT = "case c_custkey%5 when 0 then 'hospital' when 1 then 'pharmacy' when 2 then 'school' when 3 then 'bank' else 'dentist' end"


def _places(v):
    p = v.table("customer").selectExpr(
        "c_custkey as id", "named_struct('primary', c_name) as names", f"named_struct('primary', {_CAT}) as categories",
        f"named_struct('xmin', {_PX}, 'xmax', {_PX}+0.5e0, 'ymin', {_PY}, 'ymax', {_PY}+0.5e0) as bbox", "cast(cast(c_custkey as string) as binary) as geometry")
    return materialize(p, "places")


@query("scan_places", f"select id, name, amenity from (select c_custkey as id, c_name as name, {_CAT} as amenity from customer where {_PX}+0.5e0 >= 20 and {_PX} <= 90 and {_PY}+0.5e0 >= 10 and {_PY} <= 60) where amenity in ('hospital','pharmacy')")
def scan_places(v):
    return readers.scan_places(_places(v), (20.0, 10.0, 90.0, 60.0), ["hospital", "pharmacy"]).select("id", "name", "amenity")


_SUB = "case c_custkey%6 when 0 then 'country' when 1 then 'region' when 2 then 'county' when 3 then 'locality' when 4 then 'localadmin' else 'neighborhood' end"
_CTY = "case c_custkey%3 when 0 then 'PE' else 'US' end"


def _divisions(v):
    return v.table("customer").selectExpr(
        "c_custkey as id", f"{_SUB} as subtype", "named_struct('primary', c_name) as names", f"{_CTY} as country", "c_acctbal as population",
        f"named_struct('xmin', {_PX}, 'xmax', {_PX}+0.5e0, 'ymin', {_PY}, 'ymax', {_PY}+0.5e0) as bbox")


_DBOX = f"{_PX}+0.5e0 >= 0 and {_PX} <= 100 and {_PY}+0.5e0 >= 0 and {_PY} <= 70"


@query("search_divisions", f"select c_custkey as id, {_SUB} as subtype, c_name as name, {_CTY} as country, c_acctbal as population from customer where {_DBOX} and {_SUB} in ('locality','county','region') and contains(lower(c_name), '1') and {_CTY}='US'")
def search_divisions(v):
    return readers.search_divisions(_divisions(v), (0.0, 0.0, 100.0, 70.0), ["locality", "county", "region"], " 1 ", "us")


@query("division_area_by_id", f"select c_custkey//3 as division_id, min(c_custkey) as area_id from customer where {_DBOX} and (c_custkey//3)%4=1 group by 1")
def division_area_by_id(v):
    a = v.table("customer").selectExpr("c_custkey div 3 as division_id", "c_custkey as area_id", "cast(cast(c_custkey as string) as binary) as geometry",
                                       f"named_struct('xmin', {_PX}, 'xmax', {_PX}+0.5e0, 'ymin', {_PY}, 'ymax', {_PY}+0.5e0) as bbox")
    want = v.table("customer").selectExpr("c_custkey div 3 as division_id").where("division_id % 4 = 1").distinct()
    return readers.division_areas(a, want, (0.0, 0.0, 100.0, 70.0)).select("division_id", "area_id")


@query("scan_places_by_label", f"select c_custkey as id, case when c_custkey%8=0 then '' else c_name end as name, {_PX} as longitude, {_PY} as latitude from customer where {_PX} between 10 and 120 and {_PY} between 5 and 70 and c_custkey%11<>0 and c_custkey%4 in (0,1)")
def scan_places_by_label(v):
    p = v.table("customer").selectExpr("c_custkey as id", "case when c_custkey%8<>0 then c_name end as name", f"case when c_custkey%11<>0 then {_PX} end as longitude", f"{_PY} as latitude",
                                       "case c_custkey%4 when 0 then array('Retail', 'Health > HOSPITAL ward') when 1 then array('Medical Center') when 2 then array('Bank') else cast(array() as array<string>) end as labels")
    return readers.scan_places_by_label(p, (10.0, 5.0, 120.0, 70.0), ["Hospital", "Medical Center"])


_XY = "'\"lon\":', cast(s_suppkey%170 as string), '.5,\"lat\":', cast(s_suppkey%80 as string), '.25'"
_TAG = "case s_suppkey%4 when 0 then '\"amenity\":\"clinic\",\"name\":\"A\"' when 1 then '\"healthcare\":\"centre\",\"name:en\":\"B\"' when 2 then '\"amenity\":\"clinic\",\"healthcare\":\"centre\"' else '\"shop\":\"x\",\"name\":\"\"' end"
_OSM = (f"concat('{{\"elements\":[{{\"type\":\"node\",\"id\":', cast(s_suppkey as string), ',', {_XY}, ',\"tags\":{{', {_TAG}, '}}}},{{\"type\":\"way\",\"id\":', cast(s_suppkey+1000000 as string), ',\"center\":{{', {_XY}, '}},\"tags\":{{', {_TAG}, '}}}},"
        "{\"type\":\"way\",\"id\":7}]}')")


@query("flatten_osm_elements", """select s_suppkey, s_suppkey+o as osm_id, case s_suppkey%4 when 0 then 'A' when 1 then 'B' else '' end as name, case s_suppkey%4 when 0 then 'clinic' when 1 then 'centre' when 2 then 'clinic' else 'health' end as amenity,
 s_suppkey%170+0.5e0 as lon, s_suppkey%80+0.25e0 as lat from supplier, (values (0),(1000000)) t(o)""")
def flatten_osm_elements(v):
    docs = v.table("supplier").select("s_suppkey", F.expr(_OSM).alias("doc"))
    return readers.flatten_elements(docs, "doc", "health", ["s_suppkey"])


_RES = ("concat('[{\"name\":\"a\",\"format\":\"', case p_partkey%5 when 0 then 'XLSX' when 1 then 'CSV' when 2 then '' else 'pdf' end, '\",\"url\":\"', case p_partkey%4 when 0 then '' else concat('http://x/', cast(p_partkey as string), case p_partkey%3 when 0 then '.GeoJSON' else '.zip' end) end, '\"},"
        "{\"name\":\"b\",\"format\":\"', case p_partkey%2 when 0 then 'json' else 'doc' end, '\",\"url\":\"http://y/', cast(p_partkey as string), '\"}]')")


@query("pick_open_data_resource", """with r as (select p_partkey//4 as q, p_partkey as ord, 0 as pos, case p_partkey%5 when 0 then 'xlsx' when 1 then 'csv' when 2 then '' else 'pdf' end as fmt, case p_partkey%4 when 0 then '' else concat('http://x/', p_partkey, case p_partkey%3 when 0 then '.GeoJSON' else '.zip' end) end as url from part
 union all select p_partkey//4, p_partkey, 1, case p_partkey%2 when 0 then 'json' else 'doc' end, concat('http://y/', p_partkey) from part),
 k as (select *, case when fmt in ('geojson','json') or lower(url) like '%.geojson' then 'geojson' when fmt='csv' then 'csv' end as kind from r where url<>'')
 select q, arg_min(url, (ord,pos)) as url, arg_min(kind, (ord,pos)) as kind from k where kind is not null group by 1""")
def pick_open_data_resource(v):
    p = v.table("part").selectExpr("p_partkey div 4 as q", "p_partkey as ord", f"{_RES} as res")
    return readers.pick_open_data_resource(p, ["q"], "ord", "res")


_PRES = ("concat('[{\"name\":\"pop_', cast(2000+p_partkey%25 as string), case p_partkey%3 when 0 then '.gpkg.gz' when 1 then '.csv' else '_part_1.csv' end, '\",\"format\":\"\"},{\"name\":\"', case p_partkey%4 when 0 then 'children' when 1 then 'all' else 'zz' end, '_', cast(p_partkey%10 as string), '\",\"format\":\"', case p_partkey%2 when 0 then 'Geopackage' else 'CSV' end, '\"}]')")


@query("pick_population_resource", """with d as (select p_partkey//5 as country, p_partkey as ord, case p_partkey%7 when 0 then 1 when 1 then 2 when 2 then 2 end as tier, p_partkey from part),
 r as (select country, ord, tier, concat('pop_', 2000+p_partkey%25, case p_partkey%3 when 0 then '.gpkg.gz' when 1 then '.csv' else '_part_1.csv' end) as resource, case p_partkey%3 when 0 then 1 when 1 then 2 end as k from d where tier is not null
 union all select country, ord, tier, concat(case p_partkey%4 when 0 then 'children' when 1 then 'all' else 'zz' end, '_', p_partkey%10), case p_partkey%2 when 0 then 1 else 2 end from d where tier is not null and p_partkey%4<>0)
 select country, tier, max(resource) as resource, case when k=1 then 'gpkg' else 'csv' end as kind from r where k is not null and (tier, ord, k) = (select min((tier, ord, k)) from r q where q.country=r.country and q.k is not null) group by country, tier, k""")
def pick_population_resource(v):
    p = v.table("part").selectExpr("p_partkey div 5 as country", "p_partkey as ord", "case p_partkey%7 when 0 then 'Kontur-Population-x' else 'other' end as name",
                                   "case p_partkey%7 when 1 then 'WorldPop counts' when 2 then 'High Resolution Population map' else 'Rainfall' end as title", f"{_PRES} as res")
    return readers.pick_population_resource(p, ["country"], "res")


_REL = "concat('./', case when p_partkey%3=0 then 'none' else concat('2025-', lpad(cast(1+p_partkey%12 as string), 2, '0'), '-15.', cast(p_partkey%4 as string)) end, '/catalog.json')"


@query("latest_release", f"select p_brand, coalesce(max(nullif(regexp_extract(h, '(\\d{{4}}-\\d{{2}}-\\d{{2}}\\.\\d+)', 1), '')), '2026-04-15.0') as release from (select p_brand, {_REL} as h from part) group by 1")
def latest_release(v):
    p = v.table("part").select("p_brand", F.expr(_REL).alias("href"), F.col("p_name").alias("title"))
    return readers.latest_release(p, ["p_brand"], ["href", "title"], None, "2026-04-15.0")


_PROVIDERS = datasource.Registry(
    datasource.Provider("customers", "Customers on a grid of places", ("demand", "points"),
                        {"place_id": "c_custkey", "name": "c_name", "lon": "cast(c_custkey % 360 as double) - 180", "lat": "cast(c_nationkey as double) * 3 - 40", "weight": "c_acctbal"}),
    datasource.Provider("suppliers", "Suppliers by balance and nation", ("facilities", "points"),
                        {"place_id": "s_suppkey", "name": "s_name", "lon": "s_acctbal / 100", "lat": "cast(s_nationkey as double) * 3 - 40"}),
)


@query("source_registry", """with p as (select 'customers' as provider, c_custkey as place_id, c_name as name, cast(c_custkey % 360 as double) - 180 as lon, cast(c_nationkey as double) * 3 - 40 as lat, cast(c_acctbal as double) as weight from customer
 union all select 'suppliers', s_suppkey, s_name, cast(s_acctbal / 100 as double), cast(s_nationkey as double) * 3 - 40, null from supplier)
 select provider, place_id, name, round(lon, 6) as lon, lat, weight from p where lon between -90 and 90 and lat between -30 and 30""")
def source_registry(v):
    """Places of two providers in a box, in one layout."""
    got = _PROVIDERS.fetch_all(v.spark, {"customers": f"{v.dir}/customer.parquet", "suppliers": f"{v.dir}/supplier.parquet"}, (-90.0, -30.0, 90.0, 30.0))
    return got.withColumn("lon", F.round("lon", 6))


@query("road_edges", """select e.aoi_id, e.src, e.dst, e.length_m from road_edges e join road_nodes a on a.aoi_id=e.aoi_id and a.node_id=e.src join road_nodes b on b.aoi_id=e.aoi_id and b.node_id=e.dst
 where a.lon between -60.02e0 and 30.43e0 and a.lat between -20.02e0 and 25.42e0 and b.lon between -60.02e0 and 30.43e0 and b.lat between -20.02e0 and 25.42e0""", ("road_nodes", "road_edges"))
def road_edges(v):
    return readers.roads_in_box(v.road_nodes(), v.road_edges(), (-60.0, -20.0, 30.41, 25.4)).select("aoi_id", "src", "dst", "length_m")


_PHO = ("concat('{\"geometry\":{\"coordinates\":[', cast(c_custkey%170 as string), '.5,', cast(c_custkey%80 as string), '.25]},\"properties\":{\"osm_key\":\"', case c_custkey%3 when 0 then 'place' else 'boundary' end, '\",\"osm_value\":\"', case c_custkey%3 when 0 then 'city' else 'administrative' end,"
        " '\",\"name\":\"', case c_custkey%4 when 0 then '' else c_name end, '\",\"state\":\"S\",\"country\":\"', case c_custkey%2 when 0 then 'Peru' else '' end, '\",\"extent\":[5.0,9.0,1.0,2.0],\"osm_type\":\"R\",\"osm_id\":', cast(c_custkey as string), '}}')")
_NOM = ("concat('{\"lat\":\"', cast(c_custkey%80 as string), '.25\",\"lon\":\"', case when c_custkey%10=0 then 'bad' else cast(c_custkey%170 as string) end, '\",\"display_name\":\"Z, ', c_name, '\",\"osm_type\":\"', case c_custkey%3 when 0 then 'relation' when 1 then 'way' else 'area' end, '\",\"osm_id\":', cast(c_custkey as string), ',\"place_rank\":', cast(c_custkey%30 as string), ',\"type\":\"', case c_custkey%2 when 0 then 'city' else '' end, '\",\"class\":\"boundary\",\"boundingbox\":[\"1\",\"2\",\"3\",\"4\"],\"address\":{\"town\":\"', case c_custkey%4 when 0 then 'T' else '' end, '\",\"country\":\"Chile\"}}')")
_PHOSQL = """select c_custkey, 'photon' as provider, concat_ws(', ', short_name, context) as display_name, short_name, context, case c_custkey%3 when 0 then 'city' else 'admin_area' end as kind, c_custkey%80+0.25e0 as lat, c_custkey%170+0.5e0 as lon, 1e0 as x0, 2e0 as y0, 5e0 as x1, 9e0 as y1, 'R' as osm_type, c_custkey as osm_id, case c_custkey%3 when 0 then 16 else 10 end as rank
 from (select c_custkey, case c_custkey%4 when 0 then 'S' else c_name end as short_name, case c_custkey%2 when 0 then 'S, Peru' else 'S' end as context from customer)"""
_NOMSQL = """select c_custkey, 'nominatim', concat('Z, ', c_name), case c_custkey%4 when 0 then 'T' else 'Chile' end, 'Chile', case c_custkey%2 when 0 then 'city' else 'boundary' end, c_custkey%80+0.25e0, cast(c_custkey%170 as double), 3e0, 1e0, 4e0, 2e0, case c_custkey%3 when 0 then 'R' when 1 then 'W' end, c_custkey, cast(c_custkey%30 as int) from customer where c_custkey%10<>0"""


def candidates_of_places(v):
    c = v.table("customer")
    a = readers.place_candidates(c.select("c_custkey", F.expr(_PHO).alias("doc")), "doc", "photon", ["c_custkey"]).withColumn("provider", F.lit("photon"))
    b = readers.place_candidates(c.select("c_custkey", F.expr(_NOM).alias("doc")), "doc", "nominatim", ["c_custkey"]).withColumn("provider", F.lit("nominatim"))
    return a.unionByName(b)


@query("resolve_place_candidates", f"{_PHOSQL} union all {_NOMSQL}")
def resolve_place_candidates(v):
    return candidates_of_places(v)


@query("rank_places", f"with p as ({_PHOSQL} union all {_NOMSQL}) select q, rank_no, c_custkey, provider from (select c_custkey%50 as q, c_custkey, provider, row_number() over (partition by c_custkey%50 order by case when osm_type='R' then 0 else 1 end, rank, c_custkey, provider) as rank_no from p) where rank_no <= 8")
def rank_places(v):
    from ..operators.dedup import best_per_key

    p = candidates_of_places(v).withColumn("q", F.col("c_custkey") % 50)
    first = F.when(F.col("osm_type") == "R", 0).otherwise(1)
    return best_per_key(p, ["q"], [first.asc(), F.asc("rank"), F.asc("c_custkey"), F.asc("provider")], 8, rank="rank_no").select("q", "rank_no", "c_custkey", "provider")


@query("bbox_fallback_polygon", "with r as (select s_suppkey, cast(s_suppkey%100 as double) as x0, cast(s_suppkey%50 as double) as y0, s_suppkey%100+case when s_suppkey%9=0 then 0e0 else 2e0 end as x1, s_suppkey%50+1e0 as y1 from supplier where s_suppkey%3=0) "
       "select s_suppkey, 0 as seq, x0 as x1, y0 as y1, x1 as x2, y0 as y2, 'bbox_fallback' as source from r where x0<x1 union all select s_suppkey, 1, x1, y0, x1, y1, 'bbox_fallback' from r where x0<x1 union all select s_suppkey, 2, x1, y1, x0, y1, 'bbox_fallback' from r where x0<x1 union all select s_suppkey, 3, x0, y1, x0, y0, 'bbox_fallback' from r where x0<x1")
def bbox_fallback_polygon(v):
    r = v.table("supplier").selectExpr("s_suppkey", "s_suppkey%3 as n_polygons", "cast(s_suppkey%100 as double) as x0", "cast(s_suppkey%50 as double) as y0", "s_suppkey%100+case when s_suppkey%9=0 then 0e0 else 2e0 end as x1", "s_suppkey%50+1e0 as y1")
    return readers.bbox_fallback_edges(r, "s_suppkey")
