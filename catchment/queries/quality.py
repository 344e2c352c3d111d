"""Column roles, cleaning, validation and scenario checks."""

from pyspark.sql import functions as F

from ..operators import dedup, measures, polygon, quality
from ..sources import catalog
from .registry import query

# A catalog of columns of many datasets, derived from the parts: eight columns per dataset.
_NAMES = ("id", "Longitude", "LAT", "Population 2015", "pop_2020", "Capacity", "open_cost", "name", "x", "y", "expected_value", "pop_method",
          "weight", "Population", "lon_dd", "site score", "persons_total", "W")
COLUMNS = [
    "p_partkey//8 as dataset",
    "cast(p_partkey%8 as int) as ordinal",
    "case (p_partkey*37+11)%18 " + " ".join(f"when {i} then '{n}'" for i, n in enumerate(_NAMES)) + " end as name",
    "p_partkey%5 <> 0 as is_numeric",
    "cast(p_partkey%5 as double)/40e0 as bad_frac",
    "cast(p_partkey%7 as double) - 1e0 as min_v",
    "p_retailprice as max_v",
]
CSQL = "c as (select " + ", ".join(COLUMNS) + " from part)"


def columns(v):
    return v.table("part").selectExpr(*[c.replace("//", " div ") for c in COLUMNS])


def _in(names):
    return ", ".join(f"'{n}'" for n in names)


def _ord(c, names):
    return f"case {c} " + " ".join(f"when '{n}' then {i}" for i, n in enumerate(names)) + " end"


_N = "regexp_replace(regexp_replace(lower(trim(name)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"


@query("detect_coord_columns", f"with {CSQL} select dataset, arg_min(name, ({_ord('lower(name)', catalog.LON_NAMES)}, ordinal)) filter (lower(name) in ({_in(catalog.LON_NAMES)})) as lon_col,"
       f" arg_min(name, ({_ord('lower(name)', catalog.LAT_NAMES)}, ordinal)) filter (lower(name) in ({_in(catalog.LAT_NAMES)})) as lat_col,"
       f" arg_min(name, ordinal) filter ({_N} in ({_in(catalog.WIDE_LON_NAMES)})) as wide_lon_col, arg_min(name, ordinal) filter ({_N} in ({_in(catalog.WIDE_LAT_NAMES)})) as wide_lat_col from c group by 1")
def detect_coord_columns(v):
    return catalog.coord_columns(columns(v))


@query("resolve_population_column", f"""with {CSQL}, n as (select *, {_N} as n from c), u as (select *, coalesce(try_cast(nullif(regexp_extract(n, '((?:19|20)[0-9]{{2}})', 1), '') as int), 0) as y from n
 where bad_frac <= 0.05 and not regexp_matches(n, '({'|'.join(catalog.NOT_POPULATION_SUFFIXES)})$')),
 t as (select *, case when n in ({_in(catalog.POPULATION_NAMES)}) then 1 when regexp_matches(n, '^(population_|pop_)') and y>0 then 2 when regexp_matches(n, '^(population_|pop_)') then 3 when regexp_matches(n, 'population|persons') then 4 end as tier from u)
 select dataset, arg_min(name, (tier, case when tier=2 then -y else 0 end, case when tier=2 then length(n) else 0 end, ordinal)) as pop_col, min(tier) as tier from t where tier is not null group by 1""")
def resolve_population_column(v):
    return catalog.population_column(columns(v))


@query("profile_role_columns", f"""with {CSQL} select dataset, name, role from c, (values ('capacity', '{'|'.join(catalog.CAPACITY_WORDS)}'), ('cost', '{'|'.join(catalog.COST_WORDS)}'), ('demand', '{'|'.join(catalog.DEMAND_WORDS)}')) r(role, words)
 where is_numeric and regexp_matches(lower(name), words)""")
def profile_role_columns(v):
    return catalog.role_columns(columns(v))


_REQ = "case dataset%3 when 0 then 'Expected_Val' when 1 then 'weight' else 'nothing' end"


@query("resolve_weight", f"""with {CSQL}, q as (select *, lower(name) l, lower({_REQ}) r from c), t as (select *, case when l=r then 1 when starts_with(l, substr(r,1,6)) or starts_with(r, substr(l,1,6)) then 2 when l in ('population','pop','demand','weight') then 3
 when regexp_matches(l, '{'|'.join(catalog.WEIGHT_TOKENS)}') then 4 end as tier from q where is_numeric and min_v >= 0)
 select d.dataset, w.weight_col from (select distinct dataset from c) d left join (select dataset, arg_min(name, (tier, case when tier=3 then {_ord('l', ('population', 'pop', 'demand', 'weight'))} else 0 end, ordinal)) as weight_col from t where tier is not null group by 1) w using (dataset)""")
def resolve_weight(v):
    c = columns(v)
    return catalog.weight_column(c, F.expr(_REQ))


@query("infer_weight_column", f"""with {CSQL}, s as (select *, lower(name) l, {' + '.join(f"case when contains(lower(name), '{w}') then 10 else 0 end" for w in catalog.HINT_WORDS)}
 + case when abs(min_v-0)<0.5 and abs(max_v-910)<0.5 then 100 when min_v<=0 and max_v>=910 then 50 else 0 end as score from c where is_numeric and not regexp_matches(lower(name), '{'|'.join(catalog.HINT_EXCLUDED)}'))
 select dataset, arg_min(name, (-score, ordinal)) as weight_col, max(score) as score from s where score > 0 group by 1""")
def infer_weight_column(v):
    return catalog.hinted_weight_column(columns(v), F.lit(0.0), F.lit(910.0))


# customers as uploads from ten sources; some mix up or spoil their coordinates
_RAW = ["c_custkey", "cast(c_custkey%10 as int) as src",
        "cast(case c_custkey%10 when 3 then 100e0+cast(c_custkey%70 as double) when 4 then 500e0 else cast(c_custkey%80 as double) end as string) as lat0",
        "cast(case c_custkey%10 when 3 then cast(c_custkey%80 as double) when 4 then 800e0 else cast(c_custkey%170 as double) end as string) as lon0"]
_RAW2 = ["c_custkey", "src", "case when c_custkey%37=0 then 'n/a' else lat0 end as lat", "case when c_custkey%41=0 then null else lon0 end as lon"]
RAWSQL = f"raw as (select {', '.join(_RAW2)} from (select {', '.join(_RAW)} from customer))"


def raw_points(v):
    return v.table("customer").selectExpr(*_RAW).selectExpr(*_RAW2)


@query("sanitise_latlon", f"""with {RAWSQL}, n as (select c_custkey, src, try_cast(lat as double) lat, try_cast(lon as double) lon from raw where try_cast(lat as double) is not null and try_cast(lon as double) is not null),
 k as (select src, avg(case when lat between -90 and 90 and lon between -180 and 180 then 1e0 else 0e0 end) ok, avg(case when lon between -90 and 90 and lat between -180 and 180 then 1e0 else 0e0 end) sw from n group by 1),
 d as (select src, case when ok>=0.95 then 'ok' when sw>ok and sw>=0.95 then 'swapped' else 'error' end as verdict from k)
 select c_custkey, src, verdict, case when verdict='swapped' then lon else lat end as lat, case when verdict='swapped' then lat else lon end as lon from n join d using (src)""")
def sanitise_latlon(v):
    return quality.sanitise_latlon(raw_points(v), ["src"])


@query("validate_points", f"""with {RAWSQL}, n as (select src, try_cast(lat as double) lat, try_cast(lon as double) lon from raw) select src, count(*) as n_rows, count(*) filter (lat is null or lon is null) as n_missing,
 count(*) filter (lat is not null and lon is not null and not (lon between -180 and 180 and lat between -90 and 90)) as n_out_of_range,
 count(*) filter (lat is not null and lon is not null) - count(distinct (lat, lon)) filter (lat is not null and lon is not null) as n_duplicate from n group by 1""")
def validate_points(v):
    d = raw_points(v).select("src", F.col("lat").try_cast("double").alias("lat"), F.col("lon").try_cast("double").alias("lon"))
    return quality.validate_points(d, ["src"])


@query("clean_geometries", f"""with {RAWSQL} select c_custkey, try_cast(lon as double) as lon, try_cast(lat as double) as lat, case when try_cast(lat as double) is null or try_cast(lon as double) is null then 'no coordinates'
 when not (try_cast(lon as double) between -180 and 180 and try_cast(lat as double) between -90 and 90) then 'outside the globe' end as quarantine from raw""")
def clean_geometries(v):
    lon, lat = F.col("lon").try_cast("double"), F.col("lat").try_cast("double")
    why = F.when(lon.isNull() | lat.isNull(), "no coordinates").when(~(lon.between(-180, 180) & lat.between(-90, 90)), "outside the globe")
    return raw_points(v).select("c_custkey", lon.alias("lon"), lat.alias("lat"), why.alias("quarantine"))


@query("extract_measure", f"""with {RAWSQL}, m as (select c_custkey, try_cast(lat as double)-20e0 as x from raw) select c_custkey, case when coalesce(x,1e0)<=0 then 1e0 else coalesce(x,1e0) end as capacity, greatest(coalesce(x,0e0),0e0) as cost, greatest(coalesce(x,0e0),0e0) as demand from m""")
def extract_measure(v):
    x = F.col("lat").try_cast("double") - 20.0
    return raw_points(v).select("c_custkey", quality.measure_capacity(x).alias("capacity"), quality.measure_cost(x).alias("cost"), quality.measure_demand(x).alias("demand"))


@query("default_weight", f"with {RAWSQL} select c_custkey, coalesce(try_cast(lat as double), 1e0) as weight from raw")
def default_weight(v):
    d = raw_points(v).select("c_custkey", F.col("lat").try_cast("double").alias("weight"))
    return quality.default_weight(d)


@query("positive_population", f"with {RAWSQL} select c_custkey, try_cast(lat as double)-40e0 as pop from raw where try_cast(lat as double)-40e0 > 0")
def positive_population(v):
    return raw_points(v).select("c_custkey", (F.col("lat").try_cast("double") - 40.0).alias("pop")).where("pop > 0")


@query("classify_dataset_role", "with d as (select p_partkey, concat(case p_partkey%6 when 0 then 'Boundary_' when 1 then 'demand_' when 2 then 'lima_facilities_' when 3 then 'generated_' when 4 then 'us_population_' else 'misc_' end, p_name) as n, "
       "case p_partkey%5 when 0 then 'id population' when 1 then 'id site' when 2 then 'id border' else 'id q' end as cols, case p_partkey%3 when 0 then 'Point' when 1 then 'Polygon' else 'Raster' end as g from part) "
       "select p_partkey, case when starts_with(lower(n),'boundary') then 'boundary' when starts_with(lower(n),'demand') or contains(lower(n),'population') then 'demand' when regexp_matches(lower(n),'candidate|facilit|generated') then 'candidate' else 'other' end as role, "
       "case when regexp_matches(cols,'demand|population|need|service') then 'demand_points' when regexp_matches(cols,'candidate|site|facility|location') then 'candidate_sites' when regexp_matches(cols,'boundary|border|region|area') then 'boundary' when g='Point' then 'points' when g='Polygon' then 'polygons' else 'unknown' end as data_type from d")
def classify_dataset_role(v):
    p = v.table("part").selectExpr(
        "p_partkey", "concat(case p_partkey%6 when 0 then 'Boundary_' when 1 then 'demand_' when 2 then 'lima_facilities_' when 3 then 'generated_' when 4 then 'us_population_' else 'misc_' end, p_name) as n",
        "case p_partkey%5 when 0 then 'id population' when 1 then 'id site' when 2 then 'id border' else 'id q' end as cols", "case p_partkey%3 when 0 then 'Point' when 1 then 'Polygon' else 'Raster' end as g",
    )
    return p.select("p_partkey", catalog.dataset_role(F.col("n")).alias("role"), catalog.data_type(F.col("cols"), F.col("g")).alias("data_type"))


@query("bbox_filter", "select demand_id from demand where lon between -59.8e0 and 0.4e0 and lat between -19.9e0 and 10.3e0", ("demand",))
def bbox_filter(v):
    return v.demand().where("lon between -59.8e0 and 0.4e0 and lat between -19.9e0 and 10.3e0").select("demand_id")


@query("column_stats", " union all ".join(f"select s_nationkey, '{c}' as \"column\", count({c}) as n, count({c}) - count(try_cast({c} as double)) as n_bad, arg_min(cast({c} as varchar), s_suppkey) filter ({c} is not null) as first, round(avg(try_cast({c} as double)),6) as mean, min(try_cast({c} as double)) as min, max(try_cast({c} as double)) as max from supplier group by 1" for c in ("s_suppkey", "s_name")))
def column_stats(v):
    s = quality.column_stats(v.table("supplier"), ["s_suppkey", "s_name"], "s_suppkey", ["s_nationkey"])
    return s.withColumn("mean", F.round("mean", 6))




@query("reduce_to_points", """with p as (select s_suppkey, s_suppkey%3 as kind, cast(s_suppkey%50 as double) as x, cast(s_suppkey%40 as double) as y, case when s_suppkey%10=1 then 0e0 else 1e0+s_suppkey%4 end as side from supplier)
 select s_suppkey, case when kind=0 then 'point' when side=0 then 'dropped' else 'centroid' end as outcome, case when kind=0 then x when side=0 then null else round(x+side/2e0,9) end as lon, case when kind=0 then y when side=0 then null else round(y+side/2e0,9) end as lat from p""")
def reduce_to_points(v):
    p = v.table("supplier").selectExpr("s_suppkey", "s_suppkey%3 as kind", "cast(s_suppkey%50 as double) as x", "cast(s_suppkey%40 as double) as y", "case when s_suppkey%10=1 then 0e0 else 1e0+s_suppkey%4 end as side")
    pts = p.where("kind = 0").select("s_suppkey", F.lit("point").alias("outcome"), F.col("x").alias("lon"), F.col("y").alias("lat"))
    sq = [(0, 0, 1, 0), (1, 0, 1, 1), (1, 1, 0, 1), (0, 1, 0, 0)]
    e = F.explode(F.array(*[F.struct(*[F.lit(c).alias(n) for n, c in zip("abcd", r)]) for r in sq]))
    edges = p.where("kind <> 0").select("s_suppkey", "x", "y", "side", e.alias("e")).selectExpr(
        "s_suppkey", "x + e.a*side as x1", "y + e.b*side as y1", "x + e.c*side as x2", "y + e.d*side as y2")
    c = measures.polygon_centroid(edges, ["s_suppkey"])
    flat = F.col("area_deg2") == 0
    c = c.select("s_suppkey", F.when(flat, "dropped").otherwise("centroid").alias("outcome"), F.when(~flat, F.round("lon", 9)).alias("lon"), F.when(~flat, F.round("lat", 9)).alias("lat"))
    return pts.unionByName(c)


@query("amenity_filter", "select aoi_id, poi_id, amenity from poi_a where (aoi_id, amenity) in (select aoi_id, amenity from poi_a group by 1,2 having count(*) >= 5)", ("poi_a",))
def amenity_filter(v):
    p = v.poi_a()
    active = p.groupBy("aoi_id", "amenity").count().where("count >= 5").select("aoi_id", "amenity")
    return p.join(active, ["aoi_id", "amenity"], "left_semi").select("aoi_id", "poi_id", "amenity")


@query("validate_boundary", "select aoi_id, min(x1) as x0, max(x1) as x1, min(y1) as y0, max(y1) as y1, count(*) as n_edges, count(*)>=3 and min(x1)<max(x1) and min(y1)<max(y1) and min(x1)>=-180 and max(x1)<=180 and min(y1)>=-90 and max(y1)<=90 as valid from boundary_edges group by 1", ("boundary_edges",))
def validate_boundary(v):
    return quality.validate_boundary(v.boundary_edges())


@query("aoi_area_gate", "select aoi_id, round(area_km2,3) as area_km2, case when area_km2<0.5 then 'too small' when area_km2>50000 then 'too large' end as reason from (select aoi_id, abs(sum(radians(x1)*6371008.8e0*sin(radians(y2))*6371008.8e0 - radians(x2)*6371008.8e0*sin(radians(y1))*6371008.8e0))/2e0/1e6*power(100e0, cast(substr(aoi_id,2) as int)-2) as area_km2 from boundary_edges group by 1)", ("boundary_edges",))
def aoi_area_gate(v):
    a = measures.polygon_area(v.boundary_edges()).withColumn("area_km2", F.col("area_km2") * F.pow(F.lit(100.0), F.substring("aoi_id", 2, 9).cast("int") - 2))
    return quality.area_gate(a).select("aoi_id", F.round("area_km2", 3).alias("area_km2"), "reason")


_SRC = "case when demand_id%397=5 then 'Synthetic_uniform' else 'census' end"


@query("synthetic_gate", f"select aoi_id, bool_or(contains(lower({_SRC}),'synthetic')) as synthetic, bool_or(contains(lower({_SRC}),'synthetic')) as blocked from demand group by 1", ("demand",))
def synthetic_gate(v):
    return quality.synthetic_gate(v.demand().select("aoi_id", F.expr(_SRC).alias("data_source")), ["aoi_id"])


@query("facility_set_check", """with m as (select aoi_id, max(site_id) as mx from candidates group by 1), s as (select aoi_id, case site_id%3 when 0 then 'fixed_open' when 1 then 'existing' else 'fixed_closed' end as kind, case when site_id%29=4 then -site_id when site_id%31=6 then site_id+1000000 when site_id%4=1 then site_id//2 else site_id end as sid from candidates)
 select distinct aoi_id, 'negative id' as error from s where sid<0 union select aoi_id, 'id out of range' from s join m using (aoi_id) where sid>mx
 union select aoi_id, 'both open and closed' from (select aoi_id, sid from s where kind<>'fixed_closed' intersect select aoi_id, sid from s where kind='fixed_closed')""", ("candidates",))
def facility_set_check(v):
    c = v.candidates()
    sets = c.selectExpr("aoi_id", "case site_id%3 when 0 then 'fixed_open' when 1 then 'existing' else 'fixed_closed' end as kind",
                        "case when site_id%29=4 then -site_id when site_id%31=6 then site_id+1000000 when site_id%4=1 then site_id div 2 else site_id end as site_id")
    return quality.facility_set_errors(sets, c.groupBy("aoi_id").agg(F.max("site_id").alias("max_site")), ["aoi_id"])


# scenarios derived from the orders
_SCN = ["o_orderkey as scenario_id", "case o_orderkey%4 when 0 then 'p-median' when 1 then 'p-center' when 2 then 'mclp' else 'lscp' end as problem",
        "case o_custkey%8 when 0 then ' Budget ' when 1 then 'capacitated' when 2 then 'max-distance' when 3 then 'conditional' when 4 then 'multi-coverage' when 5 then 'backup' when 6 then 'partial' end as variant",
        "case when o_custkey%3=0 then 5000e0 end as service_radius", "case when o_custkey%5=0 then 4000e0 end as service_distance", "case when o_custkey%7=0 then 3000e0 end as distance_threshold",
        "case when o_custkey%6=0 then 3 end as k_coverage", "case when o_custkey%9=0 then 2 end as k", "case when o_custkey%4=0 then 0.9e0 end as facility_reliability", "case when o_custkey%10=0 then 0.8e0 end as reliability",
        "case when o_custkey%2=0 then o_totalprice end as budget"]


@query("scenario_validation", f"""with s as (select {', '.join(_SCN)} from orders), n as (select scenario_id, problem, replace(lower(trim(variant)),'-','_') as variant, list_filter([case when service_radius is not null then 'service_radius' end, case when k_coverage is not null then 'k_coverage' end, case when budget is not null then 'budget' end], lambda x: x is not null) as given from s),
 r(p, v, need, action) as (values {', '.join(str(r) for r in quality.SCENARIO_RULES)}) select scenario_id, need as parameter, action from n join r on p=problem and (v='*' or v=variant) and not list_contains(given, need)""")
def scenario_validation(v):
    s = v.table("orders").selectExpr(*_SCN)
    given = F.filter(F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in ("service_radius", "k_coverage", "budget")]), lambda x: x.isNotNull())
    n = s.select("scenario_id", "problem", F.regexp_replace(F.lower(F.trim("variant")), "-", "_").alias("variant"), given.alias("given"))
    return quality.scenario_findings(n)


_VALUES = ["o_orderkey as scenario_id", "case o_orderkey%5 when 0 then 'p-median' when 1 then 'p-center' when 2 then 'mclp' when 3 then 'lscp' when 4 then 'mclp' end as problem",
           "case o_custkey%9 when 0 then 'budget' when 1 then 'capacitated' when 2 then 'backup' when 3 then 'partial' when 4 then 'probabilistic' when 5 then 'conditional' when 6 then 'absolute' when 7 then 'multi_coverage' end as variant",
           "case o_custkey%4 when 0 then '3' when 1 then '2.5' when 2 then 'many' end as n_facilities", "case o_custkey%3 when 0 then o_totalprice when 1 then 0e0 end as service_radius",
           "case o_custkey%2 when 0 then o_totalprice-100000e0 end as budget", "case o_custkey%6 when 0 then 2 when 1 then 0 end as k_coverage",
           "case o_custkey%5 when 0 then 0.9e0 when 1 then 1e0 end as coverage_reliability", "case o_custkey%7 when 0 then 1e0 when 1 then 1.5e0 end as coverage_fraction"]


def _value_sql() -> str:
    """One branch a rule, over the scenarios with their variant filled in."""
    firsts = " ".join(f"when '{m}' then '{v[0]}'" for m, v in quality.VARIANTS.items())
    kinds = " or ".join(f"(problem='{m}' and v in {v})" for m, v in quality.VARIANTS.items())
    parts = [f"select scenario_id, 'variant' as parameter, 'unknown' as fault from s where not ({kinds})",
             "select scenario_id, 'n_facilities', 'missing, and no budget' from s where problem='mclp' and v='capacitated' and n_facilities is null and budget is null"]
    for model, variants, name, required, test, asked in quality.VALUE_RULES:
        read = f"problem='{model}'" + (f" and v in ({', '.join(repr(x) for x in variants)})" if variants else "")
        x = f"(select scenario_id, {name} as raw, try_cast({name} as double) as x from s where {read})"
        missing = "true" if required else "false"
        parts.append(f"select scenario_id, '{name}', case when raw is null then 'missing' when x is null then 'not a number' else 'must be {asked}' end from {x} where (raw is null and {missing}) or (raw is not null and (x is null or not ({test})))")
    return f"with t as (select {', '.join(_VALUES)} from orders), s as (select *, coalesce(variant, case problem {firsts} end) as v from t) " + " union all ".join(parts)


@query("scenario_values", _value_sql())
def scenario_values(v):
    """Every bad value of the scenarios, whichever model reads it."""
    return quality.scenario_value_faults(v.table("orders").selectExpr(*_VALUES))


@query("scenario_normalise", f"""with s as (select {', '.join(_SCN)} from orders), n as (select scenario_id, problem, coalesce(service_radius, service_distance, distance_threshold) as service_radius, coalesce(k_coverage, k) as k_coverage, coalesce(facility_reliability, reliability) as facility_reliability, budget, replace(lower(trim(variant)),'-','_') as v from s)
 select scenario_id, problem, service_radius, k_coverage, facility_reliability, budget, case when v is null or (v='budget' and budget is null) or (v in ('multi_coverage','backup') and k_coverage is null) then case when problem='mclp' then 'classical' else 'base' end else v end as variant from n""")
def scenario_normalise(v):
    return quality.scenario_normalise(v.table("orders").selectExpr(*_SCN))


@query("default_budget", "select aoi_id, round(1.1e0*sum(cost), 6) as budget from (select aoi_id, cost, row_number() over (partition by aoi_id order by cost, site_id) as r from candidates) where r <= 5 group by 1", ("candidates",))
def default_budget(v):
    cheap = dedup.best_per_key(v.candidates(), ["aoi_id"], [F.asc("cost"), F.asc("site_id")], 5)
    return cheap.groupBy("aoi_id").agg(F.round(F.sum("cost") * 1.1, 6).alias("budget"))


_EST = "case aoi_id when 'R0' then '12,345' when 'R1' then 'unknown' when 'R2' then '0' end"


@query("estimate_population", f"""select aoi_id, case when try_cast(replace(p,',','') as double) >= 1 then cast(floor(try_cast(replace(p,',','') as double)) as bigint) when floor(a*250e0) > 0 then cast(floor(a*250e0) as bigint) else 100000 end as population
 from (select aoi_id, {_EST} as p, case when aoi_id='R4' then 0e0 else abs(sum(radians(x1)*6371008.8e0*sin(radians(y2))*6371008.8e0 - radians(x2)*6371008.8e0*sin(radians(y1))*6371008.8e0))/2e0/1e6 end as a from boundary_edges group by 1)""", ("boundary_edges",))
def estimate_population(v):
    from ..plans.generate import estimate_population as estimate

    a = measures.polygon_area(v.boundary_edges()).withColumn("area_km2", F.when(F.col("aoi_id") == "R4", F.lit(0.0)).otherwise(F.col("area_km2")))
    return a.select("aoi_id", estimate(F.expr(_EST), F.col("area_km2")).alias("population"))


@query("cells_to_points", """with cells as (select demand_id, lon-0.01e0 as x, lat-0.005e0 as y, weight-100e0 as pop from demand), c as (select demand_id, round(x+0.01e0,9) as lon, round(y+0.005e0,9) as lat, pop from cells)
 select c.demand_id, c.lon, c.lat, c.pop from c join demand d using (demand_id) join boundary_edges e on e.aoi_id=d.aoi_id and (e.y1>c.lat)<>(e.y2>c.lat) and e.x1+(c.lat-e.y1)/(e.y2-e.y1)*(e.x2-e.x1) > c.lon where c.pop > 0 group by all having count(*)%2=1""", ("demand", "boundary_edges"))
def cells_to_points(v):
    d = v.demand()
    sq = [(0, 0, 1, 0), (1, 0, 1, 1), (1, 1, 0, 1), (0, 1, 0, 0)]
    e = F.explode(F.array(*[F.struct(*[F.lit(c).alias(n) for n, c in zip("abcd", r)]) for r in sq]))
    edges = d.select("aoi_id", "demand_id", "lon", "lat", (F.col("weight") - 100.0).alias("pop"), e.alias("e")).where("pop > 0").selectExpr(
        "aoi_id", "demand_id", "pop", "lon-0.01e0 + e.a*0.02e0 as x1", "lat-0.005e0 + e.b*0.01e0 as y1", "lon-0.01e0 + e.c*0.02e0 as x2", "lat-0.005e0 + e.d*0.01e0 as y2")
    c = measures.polygon_centroid(edges, ["aoi_id", "demand_id", "pop"])
    pts = c.select("aoi_id", "demand_id", F.round("lon", 9).alias("lon"), F.round("lat", 9).alias("lat"), "pop")
    return polygon.clip_to_own_polygon(pts, v.boundary_edges(), "demand_id").select("demand_id", "lon", "lat", "pop")
