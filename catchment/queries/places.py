"""Place choice and exports."""

from pyspark.sql import functions as F

from ..operators.nearest import nearest_site
from ..plans import places
from ..session import materialize, new_path
from ..sinks import export
from .registry import NEAREST_SQL, hav, query

_SUB = "case c_custkey%6 when 0 then 'country' when 1 then 'region' when 2 then 'county' when 3 then 'locality' when 4 then 'localadmin' else 'neighborhood' end"
_NM = "case c_custkey%5 when 0 then 'Lima' when 1 then 'LIMA' else 'Limache' end"


@query("best_division_with_polygon", f"""with m as (select c_custkey//20 as q, c_custkey as id, {_NM} as name, {_SUB} as subtype from customer where c_custkey%3<>1 or c_custkey%7=0), x as (select *, lower(name)='lima' as ex from m),
 e as (select * from x where ex = (select bool_or(ex) from x y where y.q=x.q)), r as (select *, row_number() over (partition by q order by case subtype when 'locality' then 0 when 'localadmin' then 1 when 'county' then 2 when 'region' then 3 else 4 end, id) as r from e)
 select q, arg_min(id, r) as id, arg_min(subtype, r) as subtype from r where id%4<>1 group by 1""")
def best_division_with_polygon(v):
    m = v.table("customer").selectExpr("c_custkey div 20 as q", "c_custkey as id", f"{_NM} as name", f"{_SUB} as subtype", "' lima ' as wanted").where("id % 3 <> 1 or id % 7 = 0")
    areas = v.table("customer").selectExpr("c_custkey as id").where("id % 4 <> 1")
    return places.best_division(m, areas, ["q"])


@query("rank_best_first", f"""with m as (select c_custkey//20 as q, c_custkey as id, {_SUB} as subtype from customer), r as (select *, row_number() over (partition by q order by abs(case subtype when 'country' then 2 when 'region' then 4 when 'county' then 6 when 'localadmin' then 7 when 'locality' then 8 else 10 end - 6), id) as r from m)
 select q, id, subtype from (select *, row_number() over (partition by q order by r) as u from r where id%3<>0) where u=1""")
def rank_best_first(v):
    """Candidates by admin-level gap; the first that can be used."""
    m = v.table("customer").selectExpr("c_custkey div 20 as q", "c_custkey as id", "'x' as name", f"{_SUB} as subtype", "'x' as wanted")
    return places.best_division(m, m.select("id").where("id % 3 <> 0"), ["q"], admin_level=6)


@query("tier_fallback", """with t as (select aoi_id, site_id, 1 as tier from candidates where aoi_id in ('R0','R1') and site_id%2=0 union all select aoi_id, site_id, 2 from candidates where aoi_id in ('R1','R2','R3') union all select aoi_id, site_id, 3 from candidates)
 select aoi_id, site_id, tier from t where tier = (select min(tier) from t q where q.aoi_id=t.aoi_id)""", ("candidates",))
def tier_fallback(v):
    c = v.candidates().select("aoi_id", "site_id")
    return places.tier_fallback([c.where("aoi_id in ('R0','R1') and site_id%2=0"), c.where("aoi_id in ('R1','R2','R3')"), c], ["aoi_id"])


_PLC = ["c_custkey", "case c_custkey%5 when 0 then 'pe' when 1 then '' when 2 then 'XX' end as code", "case c_custkey%7 when 0 then 'U.K.' when 1 then 'Nation_3' end as country",
        "case c_custkey%3 when 0 then concat('Town, Area, ', case c_custkey%2 when 0 then 'Viet Nam' else 'nation_7' end) when 1 then 'Peru, Somewhere' else 'Nowhere' end as query",
        "cast(c_custkey%40 as double)/8e0 as lon", "cast(c_custkey%24 as double)/8e0 as lat"]
_CTR = "select case n_nationkey when 4 then 'PE' else concat('Q', chr(65+n_nationkey)) end as iso2, case n_nationkey when 4 then 'PER' else concat('QQ', chr(65+n_nationkey)) end as iso3, case n_nationkey when 4 then 'Peru' else n_name end as name from {t}"


@query("resolve_country", f"""with p as (select {', '.join(_PLC)} from customer), c as ({_CTR.format(t='nation')}), look as (select lower(iso2) l, iso3 from c union all select lower(iso3), iso3 from c union all select lower(name), iso3 from c),
 tr as (select c_custkey, 0 as pos, code as raw from p union all select c_custkey, 1, country from p union all select c_custkey, 5-i, trim(parts[i]) from (select c_custkey, string_split(query, ',') as parts from p), (values (1),(2),(3)) t(i) where i <= len(parts)),
 h as (select c_custkey, pos, coalesce(case trim(replace(lower(trim(raw)),'.','')) when 'uk' then 'GBR' when 'viet nam' then 'VNM' end, iso3) as iso from tr left join look on l=lower(trim(raw)) where raw is not null and trim(raw)<>''),
 b as (select c_custkey, arg_min(iso, pos) as iso3, min(pos) as pos from h where iso is not null group by 1)
 select p.c_custkey, coalesce(b.iso3, case when round(lat*4)/4 <= 1.5 then concat('G', cast(cast(round(lon*4) as int) as varchar)) end) as iso3, case when pos=0 then 'code' when pos=1 then 'name' when pos is not null then 'query' when round(lat*4)/4 <= 1.5 then 'centroid' end as via from p left join b using (c_custkey)""")
def resolve_country(v):
    p = v.table("customer").selectExpr(*_PLC)
    v.table("nation").createOrReplaceTempView("catchment_nation")
    c = v.spark.sql(_CTR.format(t="catchment_nation"))
    q = p.select((F.round(F.col("lon") * 4) / 4).alias("qlon"), (F.round(F.col("lat") * 4) / 4).alias("qlat")).distinct()
    g = q.where("qlat <= 1.5").select("qlon", "qlat", F.concat(F.lit("G"), F.round(F.col("qlon") * 4).cast("int").cast("string")).alias("iso3"))
    return places.resolve_country(p, c, g, "c_custkey")


_PICK = "site_id % 4 = 0"


@query("label_facilities", f"""with s as (select * from candidates where {_PICK}), g as (select aoi_id, poi_id, lon, lat, name from poi_b), r as (select aoi_id, site_id, round(lon,5) as lon, round(lat,5) as lat from s)
 select r.aoi_id, r.site_id, arg_min(g.name, ({hav('r', 'g')}, g.poi_id)) as place from r join g using (aoi_id) group by r.aoi_id, r.site_id""", ("candidates", "poi_b"))
def label_facilities(v):
    g = v.poi_b().select("aoi_id", F.col("poi_id").alias("place_id"), "lon", "lat", F.col("name").alias("label"))
    return places.label_facilities(v.candidates().where(_PICK), g)


def _solution(v):
    s = v.candidates().where(_PICK)
    a = materialize(nearest_site(v.demand(), s).where("site_id is not null"), "assigned")
    return s, a


_NS = f"nr as ({NEAREST_SQL.replace('join candidates c', f'join (select * from candidates where {_PICK}) c')})"
DC = ("demand", "candidates")


@query("attach_solution_points", f"with {_NS} select nr.aoi_id, nr.site_id, nr.demand_id, nr.lon as dx, nr.lat as dy, nr.weight, s.lon as sx, s.lat as sy from nr join candidates s using (aoi_id, site_id)", DC)
def attach_solution_points(v):
    s, a = _solution(v)
    return places.attach_points(a, v.demand(), s)


@query("export_geojson_features", f"""with {_NS}, f as (select 'facility' as kind, site_id as id, 'Point' as gtype, lon as x, lat as y, cost as extra from candidates where {_PICK} union all select 'assignment', demand_id, 'LineString', lon, lat, site_id from nr) select kind, id, gtype, round(x,6) as x, round(y,6) as y, extra from f""", DC)
def export_geojson_features(v):
    """The features are written as text and read back, so the file itself is checked."""
    s, a = _solution(v)
    f = export.geojson_features(s, places.attach_points(a, v.demand(), s))
    path = new_path(v.spark, "geojson")
    export.write_geojson(f, path)
    back = v.spark.read.text(path)
    j = F.from_json("value", "type string, geometry struct<type: string, coordinates: string>, properties struct<kind: string, facility_idx: bigint, demand_idx: bigint, cost: double>")
    g = back.select(j.alias("j")).select("j.geometry.*", "j.properties.*")
    pt = F.from_json("coordinates", "array<double>")
    ln = F.from_json("coordinates", "array<array<double>>")
    fac = F.col("kind") == "facility"
    return g.select(
        "kind", F.when(fac, F.col("facility_idx")).otherwise(F.col("demand_idx")).alias("id"), F.col("type").alias("gtype"),
        F.round(F.when(fac, F.get(pt, F.lit(0))).otherwise(F.get(F.get(ln, F.lit(0)), F.lit(0))), 6).alias("x"),
        F.round(F.when(fac, F.get(pt, F.lit(1))).otherwise(F.get(F.get(ln, F.lit(0)), F.lit(1))), 6).alias("y"),
        F.when(fac, F.col("cost")).otherwise(F.col("facility_idx").cast("double")).alias("extra"),
    )


@query("export_facilities_csv", f"with {_NS}, n as (select site_id, count(*) n from nr group by 1) select site_id as facility_idx, cast(null as varchar) as name, cast(site_id as varchar) as id, printf('%.6f', lat) as lat, printf('%.6f', lon) as lon, capacity, cost, coalesce(n,0) as num_assigned_demands from candidates left join n using (site_id) where {_PICK}", DC)
def export_facilities_csv(v):
    s, a = _solution(v)
    path = new_path(v.spark, "facilities")
    export.facilities_csv(s, a).write.option("header", True).csv(path)
    return v.spark.read.option("header", True).schema("facility_idx bigint, name string, id string, lat string, lon string, capacity double, cost double, num_assigned_demands bigint").csv(path)


@query("export_long_rows", f"""with {_NS} select aoi_id, 'facility' as type, site_id as index, true as selected, null::bigint as demand_id, null::bigint as facility_id, null::varchar as metric_name, null::double as value from candidates where {_PICK}
 union all select aoi_id, 'assignment', null, null, demand_id, site_id, null, null from nr union all select aoi_id, 'metric', null, null, null, null, 'n_demand', count(*) from nr group by 1 union all select aoi_id, 'metric', null, null, null, null, 'max_m', max(dist_m) from nr group by 1""", DC)
def export_long_rows(v):
    s, a = _solution(v)
    m = a.groupBy("aoi_id").agg(F.count(F.lit(1)).alias("n_demand"), F.max("dist_m").alias("max_m"))
    return export.long_rows(s, a, m)


@query("map_layers", f"""with {_NS} select role, count(*) as n, round(sum(x),4) as sx, round(sum(y),4) as sy from (select 'boundary' as role, x1 as x, y1 as y from boundary_edges union all select 'demand', lon, lat from demand union all select 'candidate', lon, lat from candidates union all select 'selected', lon, lat from candidates where {_PICK}
 union all select 'assignment', lon, lat from nr union all select 'access_heatmap', lon, lat from nr union all select 'gap', lon, lat from nr where dist_m > 10000) group by 1""", ("demand", "candidates", "boundary_edges"))
def map_layers(v):
    s, a = _solution(v)
    lines = places.attach_points(a, v.demand(), s)
    surface = a.withColumn("is_gap", F.col("dist_m") > 10000.0)
    layers = export.map_layers(v.demand(), v.candidates(), s, lines, surface, v.boundary_edges())
    path = new_path(v.spark, "layers")
    layers.write.partitionBy("role").parquet(path)
    return v.spark.read.parquet(path).groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("x"), 4).alias("sx"), F.round(F.sum("y"), 4).alias("sy"))


@query("run_manifest", f"""select aoi_id, concat('run-', aoi_id) as run_id, n_demand, n_selected, selected_ids, '{{"p":"all","radius_m":"10000"}}' as params from (select aoi_id, count(*) as n_demand from demand group by 1) join (select aoi_id, count(*) as n_selected, string_agg(cast(site_id as varchar), ',' order by site_id) as selected_ids from candidates where {_PICK} group by 1) using (aoi_id)""", DC)
def run_manifest(v):
    n = v.demand().groupBy("aoi_id").agg(F.count(F.lit(1)).alias("n_demand"))
    m = export.run_manifest(F.concat(F.lit("run-"), F.col("aoi_id")), v.candidates().where(_PICK), n, {"p": "all", "radius_m": "10000"})
    path = new_path(v.spark, "runs")
    export.append_runs(m, path, "2026-01-01")
    back = v.spark.read.parquet(path)
    return back.select("run_id", "aoi_id", "n_demand", "n_selected", F.array_join("selected_ids", ",").alias("selected_ids"), "params")


@query("solution_history", f"select aoi_id, cast(2 as int) as version, 2 as n_versions from candidates where {_PICK} group by 1", ("candidates",))
def solution_history(v):
    path = new_path(v.spark, "history")
    s = v.candidates().where(_PICK).select("aoi_id", "site_id")
    export.append_solution(s.withColumn("version", F.lit(1)), path)
    export.append_solution(s.withColumn("version", F.lit(2)), path)
    return export.solution_versions(v.spark, path, ["aoi_id"])
