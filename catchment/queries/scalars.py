"""Scalar functions over the given tables."""

from pyspark.sql import functions as F

from ..functions import geo, scale, sql, text, units
from .registry import hav, query

CENTRE = ("demand", "boundaries")


def _with_centre(v):
    b = v.boundaries().select("aoi_id", (F.col("ox") + 0.4).alias("clon"), (F.col("oy") + 0.3).alias("clat"))
    return v.demand().join(b, "aoi_id")


@query("haversine_m", f"select aoi_id, demand_id, {hav('d', 'b')} as dist_m from demand d join "
       "(select aoi_id, ox+0.4e0 as lon, oy+0.3e0 as lat from boundaries) b using (aoi_id)", CENTRE)
def haversine_m(v):
    d = geo.mm(geo.haversine_m(F.col("lon"), F.col("lat"), F.col("clon"), F.col("clat")))
    return _with_centre(v).select("aoi_id", "demand_id", d.alias("dist_m"))


@query("geodesic_m")
def geodesic_m(v):
    d = geo.geodesic_m(F.col("lon"), F.col("lat"), F.col("clon"), F.col("clat"))
    return _with_centre(v).select("aoi_id", "demand_id", F.round(d, 3).alias("dist_m"))


_UNIT = ("case p_partkey%9 when 0 then ' KM ' when 1 then 'miles' when 2 then 'ft' when 3 then 'Nautical Miles' "
         "when 4 then 'yd' when 5 then 'm' when 6 then 'furlong' when 7 then null else 'NMI' end")
_FACTOR = ("case replace(lower(trim(unit)), ' ', '') when 'km' then 1000e0 when 'miles' then 1609.344e0 when 'ft' then 0.3048e0 "
           "when 'nauticalmiles' then 1852e0 when 'yd' then 0.9144e0 when 'm' then 1e0 when 'nmi' then 1852e0 end")


@query("to_metres", "select p_partkey, round(case when unit is null then p_retailprice else p_retailprice*f end, 6) as metres, "
       f"round(coalesce(p_retailprice/f, p_retailprice), 6) as in_unit from (select *, {_FACTOR} as f from (select *, {_UNIT} as unit from part))")
def to_metres(v):
    p = v.table("part").withColumn("unit", F.expr(_UNIT))
    val, unit = F.col("p_retailprice"), F.col("unit")
    return p.select(
        "p_partkey", F.round(units.to_metres(val, unit), 6).alias("metres"),
        F.round(units.from_metres(val, unit), 6).alias("in_unit"),
    )


@query("from_metres", f"select l_orderkey, l_linenumber, coalesce(l_extendedprice/f, l_extendedprice) as in_unit from (select *, {_FACTOR.replace('unit', 'u')} as f from (select *, {_UNIT.replace('p_partkey', 'l_partkey')} as u from lineitem))")
def from_metres(v):
    li = v.table("lineitem").withColumn("u", F.expr(_UNIT.replace("p_partkey", "l_partkey")))
    return li.select("l_orderkey", "l_linenumber", units.from_metres(F.col("l_extendedprice"), F.col("u")).alias("in_unit"))


@query("looks_like_lonlat", """
select src, aoi_id, min(x)>=-180 and max(x)<=180 and min(y)>=-90 and max(y)<=90 and max(x)-min(x)<360 and max(y)-min(y)<180
  and not (min(x)>0 and max(x)<1000 and min(y)>0 and max(y)<1000) as is_lonlat
from (select 'raw' as src, aoi_id, lon as x, lat as y from demand union all select 'scaled', aoi_id, lon*100e0, lat*100e0 from demand) group by 1, 2""",
       ("demand",))
def looks_like_lonlat(v):
    d = v.demand()
    both = d.select(F.lit("raw").alias("src"), "aoi_id", F.col("lon").alias("x"), F.col("lat").alias("y")).unionByName(
        d.select(F.lit("scaled").alias("src"), "aoi_id", (F.col("lon") * 100.0).alias("x"), (F.col("lat") * 100.0).alias("y"))
    )
    x0, x1, y0, y1 = F.min("x"), F.max("x"), F.min("y"), F.max("y")
    world = (x0 >= -180) & (x1 <= 180) & (y0 >= -90) & (y1 <= 90) & (x1 - x0 < 360) & (y1 - y0 < 180)
    grid = (x0 > 0) & (x1 < 1000) & (y0 > 0) & (y1 < 1000)
    return both.groupBy("src", "aoi_id").agg((world & ~grid).alias("is_lonlat"))


@query("n_points_from_area", "select o_orderkey, greatest(50, least(2000, cast(floor(sqrt(greatest(o_totalprice-1000e0,0e0))*8) as bigint))) as n_points from orders")
def n_points_from_area(v):
    return v.table("orders").select("o_orderkey", scale.n_points_from_area(F.col("o_totalprice") - 1000.0).alias("n_points"))


_LOC = ("case c_custkey%7 when 0 then c_name when 1 then concat(c_name, ' Province') when 2 then concat('Ward ', c_name) "
        "when 3 then concat(c_name, ', Peru') when 4 then concat(' ', c_name, ' ') when 5 then concat('Barrio ', c_name, ', State X') else '' end")
_SCALE_SQL = ("case when regexp_matches(t, 'province|state|region|department|governorate|oblast|prefecture|canton|lander|länder') then 'region' "
              "when regexp_matches(t, 'district|ward|neighbourhood|neighborhood|barrio|commune|arrondissement|upazila|quartier|sector|colonia|municipio') then 'neighborhood' "
              "when t<>'' and not contains(t, ',') and not contains(t, ' ') then 'country' else 'city' end")


@query("scale_from_location", f"select c_custkey, {_SCALE_SQL} as scale from (select c_custkey, lower(trim({_LOC})) as t from customer)")
def scale_from_location(v):
    return v.table("customer").select("c_custkey", scale.scale_from_location(F.expr(_LOC)).alias("scale"))


_SCALE_NAME = "case c_custkey%5 when 0 then 'country' when 1 then 'region' when 2 then 'city' when 3 then 'neighborhood' else 'planet' end"


@query("scale_lookups", "select c_custkey, scale, case scale when 'country' then 3 when 'region' then 5 when 'neighborhood' then 9 else 7 end as admin_level, "
       "case scale when 'country' then 15e0 when 'region' then 5e0 when 'neighborhood' then 0.5e0 else 2e0 end as buffer_deg "
       f"from (select c_custkey, {_SCALE_NAME} as scale from customer)")
def scale_lookups(v):
    c = v.table("customer").select("c_custkey", F.expr(_SCALE_NAME).alias("scale"))
    return c.select("c_custkey", "scale", scale.admin_level(F.col("scale")).alias("admin_level"), scale.bbox_buffer(F.col("scale")).alias("buffer_deg"))


@query("project", """
select demand_id, round(radians(lon)*6378137e0, 3) as merc_x, round(ln(tan(pi()/4+radians(lat)/2e0))*6378137e0, 3) as merc_y,
 round(radians(lon)*6371008.8e0, 3) as ea_x, round(sin(radians(lat))*6371008.8e0, 3) as ea_y,
 round(k*cos(radians(lat))*sin(radians(lon)-radians(clon))*6371008.8e0, 3) as az_x,
 round(k*(cos(radians(clat))*sin(radians(lat))-sin(radians(clat))*cos(radians(lat))*cos(radians(lon)-radians(clon)))*6371008.8e0, 3) as az_y
from (select *, case when abs(c)<1e-12 then 1e0 else c/sin(c) end as k from (select *, 2e0*asin(least(1e0, sqrt(sin((radians(lat)-radians(clat))/2e0)*sin((radians(lat)-radians(clat))/2e0)+cos(radians(clat))*cos(radians(lat))*(sin((radians(lon)-radians(clon))/2e0)*sin((radians(lon)-radians(clon))/2e0))))) as c
  from demand join (select aoi_id, ox+0.4e0 as clon, oy+0.3e0 as clat from boundaries) using (aoi_id)))""", CENTRE)
def project(v):
    lon, lat = F.col("lon"), F.col("lat")
    pairs = {"merc": geo.web_mercator(lon, lat), "ea": geo.equal_area(lon, lat),
             "az": geo.azimuthal(lon, lat, F.col("clon"), F.col("clat"))}
    out = [F.round(c, 3).alias(f"{n}_{a}") for n, xy in pairs.items() for a, c in zip("xy", xy)]
    return _with_centre(v).select("demand_id", *out)


@query("normalise_name", "select p_partkey, regexp_replace(regexp_replace(lower(trim(raw)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') as name, "
       "regexp_replace(lower(trim(raw)), '[ ,]+', '_', 'g') as slug from (select p_partkey, concat(' (', p_type, ') ', p_name, ' -- Total, 2015!') as raw from part)")
def normalise_name(v):
    raw = F.concat(F.lit(" ("), "p_type", F.lit(") "), "p_name", F.lit(" -- Total, 2015!"))
    return v.table("part").select("p_partkey", text.normalise_name(raw).alias("name"), text.slug(raw).alias("slug"))


@query("year_from_name", "select o_orderkey, coalesce(try_cast(nullif(regexp_extract(raw, '((?:19|20)[0-9]{2})', 1), '') as int), 0) as year "
       "from (select o_orderkey, concat('pop_', cast(o_orderkey%3000 as varchar), '_x') as raw from orders)")
def year_from_name(v):
    raw = F.concat(F.lit("pop_"), (F.col("o_orderkey") % 3000).cast("string"), F.lit("_x"))
    return v.table("orders").select("o_orderkey", text.year_from_name(raw).alias("year"))


@query("name_similar", """
select poi_id, ta = 0 or tb = 0 or i*2 >= u as similar from (select poi_id, len(a) ta, len(b) tb, len(list_intersect(a,b)) i, len(list_distinct(list_concat(a,b))) u from (
 select b.poi_id, list_distinct(regexp_extract_all(lower(a.name), '[a-z0-9]+')) a, list_distinct(regexp_extract_all(lower(case when b.poi_id%7=0 then '' else b.name end), '[a-z0-9]+')) b
 from poi_a a join poi_b b on b.poi_id = a.poi_id+100000000))""", ("poi_a", "poi_b"))
def name_similar(v):
    a = v.poi_a().select((F.col("poi_id") + 100000000).alias("poi_id"), F.col("name").alias("a"))
    b = v.poi_b().select("poi_id", F.when(F.col("poi_id") % 7 == 0, "").otherwise(F.col("name")).alias("b"))
    return a.join(b, "poi_id").select("poi_id", text.name_similar(F.col("a"), F.col("b")).alias("similar"))


_ADDR = [
    "s_suppkey",
    "case s_suppkey%3 when 0 then s_name when 1 then '' end as name",
    "case s_suppkey%4 when 0 then 'Old Town' when 1 then '' end as suburb",
    "case s_suppkey%5 when 0 then 'Main Road' end as road",
    "case s_suppkey%2 when 0 then 'Lima' end as city",
    "case s_suppkey%7 when 0 then 'Old Town' end as town",
    "case s_suppkey%11 when 0 then 'Callao' end as county",
]


@query("label_from_address", f"""select s_suppkey, nullif(concat_ws(', ', s, case when s is null or s <> a then a end), '') as label from
 (select s_suppkey, coalesce(nullif(name,''), nullif(suburb,''), nullif(road,'')) s, coalesce(nullif(city,''), nullif(town,''), nullif(county,'')) a
  from (select {', '.join(_ADDR)} from supplier))""")
def label_from_address(v):
    a = v.table("supplier").selectExpr(*_ADDR)
    lab = text.label_from_address([F.col(c) for c in ("name", "suburb", "road")], [F.col(c) for c in ("city", "town", "county")])
    return a.select("s_suppkey", lab.alias("label"))


_KEYVAL = ["s_suppkey", "case s_suppkey%4 when 0 then 'place' when 1 then 'boundary' when 2 then '' else 'shop' end as k",
           "case s_suppkey%7 when 0 then 'city' when 1 then 'administrative' when 2 then 'town' when 3 then '' when 4 then 'suburb' when 5 then 'country' else 'bakery' end as v"]


@query("place_kind_rank", f"""select s_suppkey, kind, case kind when 'country' then 4 when 'admin_area' then 10 when 'city' then 16 when 'town' then 18
 when 'suburb' then 22 else 30 end as rank from (select s_suppkey, case when k='boundary' and v='administrative' then 'admin_area'
 else coalesce(nullif(v,''), nullif(k,''), 'place') end as kind from (select {', '.join(_KEYVAL)} from supplier))""")
def place_kind_rank(v):
    s = v.table("supplier").selectExpr(*_KEYVAL).withColumn("kind", text.place_kind(F.col("k"), F.col("v")))
    return s.select("s_suppkey", "kind", text.place_rank(F.col("kind")).alias("rank"))


@query("quantise_centroid", "select demand_id, round(lon*4e0)/4e0 as qlon, round(lat*4e0)/4e0 as qlat, "
       "md5(concat(cast(cast(floor(lon*100e0) as bigint) as varchar), ',', cast(cast(floor(lat*100e0) as bigint) as varchar))) as box_key from demand", ("demand",))
def quantise_centroid(v):
    key = F.concat(F.floor(F.col("lon") * 100.0).cast("string"), F.lit(","), F.floor(F.col("lat") * 100.0).cast("string"))
    return v.demand().select(
        "demand_id", (F.round(F.col("lon") * 4.0) / 4.0).alias("qlon"), (F.round(F.col("lat") * 4.0) / 4.0).alias("qlat"), F.md5(key).alias("box_key")
    )


_ATTRS = ["c_custkey", "case c_custkey%3 when 0 then 'n/a' when 1 then cast(c_custkey as string) end as population",
          "case c_custkey%4 when 0 then 'NaN' when 1 then '7.5' end as pop", "cast(c_custkey%10 as string) as demand",
          "case c_custkey%3 when 0 then '  ' when 1 then ' Site ' end as name", "c_mktsegment as label"]


@query("first_numeric", f"""select c_custkey, coalesce(case when not isnan(try_cast(population as double)) then try_cast(population as double) end,
 case when not isnan(try_cast(pop as double)) then try_cast(pop as double) end, try_cast(demand as double)) as num from (select {', '.join(_ATTRS)} from customer)""")
def first_numeric(v):
    a = v.table("customer").selectExpr(*_ATTRS)
    return a.select("c_custkey", text.first_numeric([F.col("population"), F.col("pop"), F.col("demand")]).alias("num"))


@query("first_text", f"select c_custkey, coalesce(nullif(trim(name),''), nullif(trim(label),'')) as txt from (select {', '.join(_ATTRS)} from customer)")
def first_text(v):
    a = v.table("customer").selectExpr(*_ATTRS)
    return a.select("c_custkey", text.first_text([F.col("name"), F.col("label")]).alias("txt"))


@query("format_metric", "select o_orderkey, case when abs(x) >= 1000 then format('{:,.1f}', x) else rtrim(rtrim(printf('%.3f', x), '0'), '.') end as shown "
       "from (select o_orderkey, case when o_orderkey%2=0 then o_totalprice else o_totalprice/1000e0 end as x from orders)")
def format_metric(v):
    x = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice")).otherwise(F.col("o_totalprice") / 1000.0)
    return v.table("orders").select("o_orderkey", units.format_metric(x).alias("shown"))


@query("degradation_pct", "select l_orderkey, l_linenumber, case when b<>0 then case when l_orderkey%2=0 then b-x else x-b end/abs(b)*100e0 end as pct "
       "from (select l_orderkey, l_linenumber, l_quantity-25e0 as b, l_extendedprice/1000e0 as x from lineitem)")
def degradation_pct(v):
    li = v.table("lineitem")
    d = units.degradation_pct(F.col("l_quantity") - 25.0, F.col("l_extendedprice") / 1000.0, F.col("l_orderkey") % 2 == 0)
    return li.select("l_orderkey", "l_linenumber", d.alias("pct"))


@query("expected_reliability", """select aoi_id, round(1e0-exp(sum(ln(1e0-reliability))), 9) as any_up, round(sum(-ln(1e0-least(reliability, 1e0-1e-9))), 6) as log_need,
 round(least(1e0, sum(reliability)), 9) as surrogate from candidates group by 1""", ("candidates",))
def expected_reliability(v):
    r = F.col("reliability")
    return v.candidates().groupBy("aoi_id").agg(
        F.round(1.0 - F.exp(F.sum(F.log1p(-r))), 9).alias("any_up"),
        F.round(F.sum(-F.log1p(-F.least(r, F.lit(1.0 - 1e-9)))), 6).alias("log_need"),
        F.round(F.least(F.lit(1.0), F.sum(r)), 9).alias("surrogate"),
    )


@query("sql_functions", f"select aoi_id, demand_id, {hav('d', 'b')} as dist_m, floor(weight * 1609.344e0 * 1000e0 + 0.5e0) / 1000e0 as metres, demand_id % 3 <> 0 as similar from demand d join "
       "(select aoi_id, ox+0.4e0 as lon, oy+0.3e0 as lat from boundaries) b using (aoi_id)", CENTRE)
def sql_functions(v):
    """Distances, units and names from SQL text."""
    sql.register(v.spark)
    return v.spark.sql(
        "select aoi_id, demand_id, floor(haversine_m(lon, lat, clon, clat) * 1000 + 0.5) / 1000D as dist_m, floor(to_metres(weight, ' Miles') * 1000 + 0.5) / 1000D as metres,"
        " name_similar(concat('Site ', demand_id), case when demand_id % 3 = 0 then 'Other Place' else concat('site-', demand_id) end) as similar from {d}",
        d=_with_centre(v),
    )
