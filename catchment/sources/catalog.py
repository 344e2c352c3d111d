"""Rules over a catalog of datasets and their columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import normalise_name, year_from_name

# Column names by role, in order of preference.
LON_NAMES = ("lon", "longitude", "long", "x", "lng")
LAT_NAMES = ("lat", "latitude", "y")
WIDE_LON_NAMES = (
    "longitude", "lon", "lng", "long", "x", "xcoord", "x_coord", "lon_deg", "lon_dd", "longitud", "longitude_deg",
)
WIDE_LAT_NAMES = (
    "latitude", "lat", "y", "ycoord", "y_coord", "lat_deg", "lat_dd", "latitud", "latitude_deg",
)
POPULATION_NAMES = (
    "population", "pop", "persons", "people", "pop_count", "residents", "popcount", "pop_total", "population_total",
)
NOT_POPULATION_SUFFIXES = (
    "_method", "_source", "_year", "_note", "_comment", "_type", "_class", "_label", "_flag", "_quality", "_version",
)
CAPACITY_WORDS = (
    "capacity", "cap", "max_service", "max_capacity", "service_capacity", "throughput", "max_throughput",
    "serving_capacity", "max_load", "facility_capacity", "site_capacity", "max_demand", "demand_limit",
)
COST_WORDS = (
    "cost", "price", "expense", "budget", "investment", "capital", "facility_cost", "open_cost",
    "establishment_cost", "setup_cost",
)
DEMAND_WORDS = (
    "demand", "population", "pop", "weight", "people", "residents", "customers", "users", "clients", "visitors",
    "traffic", "volume", "demand_value", "pop_count", "resident_count", "service_demand",
)
WEIGHT_TOKENS = ("population", "pop", "weight", "demand", "expected", "value", "score", "priority")
HINT_WORDS = ("expected", "value", "score", "priority", "importance", "rating", "rank")
HINT_EXCLUDED = ("id", "name", "geometry", "geom", "lat", "lon", "longitude", "latitude", "x", "y")


def any_of(c: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def _order_in(c: Column, names) -> Column:
    """Position in the list of names, null when absent."""
    out = F.lit(None).cast("int")
    for i, n in reversed(list(enumerate(names))):
        out = F.when(c == n, F.lit(i)).otherwise(out)
    return out


def dataset_role(name: Column) -> Column:
    n = F.lower(name)
    return (
        F.when(n.startswith("boundary"), "boundary")
        .when(n.startswith("demand") | n.contains("population"), "demand")
        .when(any_of(n, ("candidate", "facilit", "generated")), "candidate")
        .otherwise("other")
    )


def data_type(columns: Column, geometry: Column) -> Column:
    """Role from the joined column names, else from the geometry type."""
    c = F.lower(columns)
    return (
        F.when(any_of(c, ("demand", "population", "need", "service")), "demand_points")
        .when(any_of(c, ("candidate", "site", "facility", "location")), "candidate_sites")
        .when(any_of(c, ("boundary", "border", "region", "area")), "boundary")
        .when(geometry == "Point", "points")
        .when(geometry.isin("Polygon", "MultiPolygon"), "polygons")
        .otherwise("unknown")
    )


def _first(df: DataFrame, cols, order, name: str) -> DataFrame:
    """The best row's column name per dataset as a plain aggregate."""
    s = F.struct(*order, F.col("name").alias("_name"))
    return df.groupBy("dataset").agg(F.min(s).alias("_m")).select("dataset", F.col("_m._name").alias(name))


def coord_columns(columns: DataFrame) -> DataFrame:
    """(dataset, lon_col, lat_col, wide_lon_col, wide_lat_col) from (dataset, ordinal, name)."""
    n = columns.withColumn("_l", F.lower("name")).withColumn("_n", normalise_name(F.col("name")))
    out = columns.select("dataset").distinct()
    for names, label in ((LON_NAMES, "lon_col"), (LAT_NAMES, "lat_col")):
        hit = n.withColumn("_o", _order_in(F.col("_l"), names)).where("_o is not null")
        out = out.join(_first(hit, None, [F.col("_o"), F.col("ordinal")], label), "dataset", "left")
    for names, label in ((WIDE_LON_NAMES, "wide_lon_col"), (WIDE_LAT_NAMES, "wide_lat_col")):
        hit = n.where(F.col("_n").isin(*names))
        out = out.join(_first(hit, None, [F.col("ordinal")], label), "dataset", "left")
    return out


def population_column(columns: DataFrame, max_bad: float = 0.05) -> DataFrame:
    """(dataset, pop_col, tier): exact name, latest year, prefix, then any mention."""
    n = normalise_name(F.col("name"))
    c = columns.withColumn("_n", n).where("_n <> ''")
    suffix = F.lit(False)
    for s in NOT_POPULATION_SUFFIXES:
        suffix = suffix | F.col("_n").endswith(s)
    c = c.where(~suffix & (F.col("bad_frac") <= max_bad)).withColumn("_y", year_from_name(F.col("_n")))
    pre = F.col("_n").startswith("population_") | F.col("_n").startswith("pop_")
    tier = (
        F.when(F.col("_n").isin(*POPULATION_NAMES), 1)
        .when(pre & (F.col("_y") > 0), 2)
        .when(pre, 3)
        .when(F.col("_n").contains("population") | F.col("_n").contains("persons"), 4)
    )
    c = c.withColumn("tier", tier).where("tier is not null")
    late = F.when(F.col("tier") == 2, -F.col("_y")).otherwise(0)
    short = F.when(F.col("tier") == 2, F.length("_n")).otherwise(0)
    s = F.struct("tier", late.alias("a"), short.alias("b"), "ordinal", "name")
    return c.groupBy("dataset").agg(F.min(s).alias("m")).select("dataset", F.col("m.name").alias("pop_col"), "m.tier")


def role_columns(columns: DataFrame) -> DataFrame:
    """(dataset, name, role) of numeric columns whose name holds a role word."""
    low = F.lower("name")
    roles = F.array(
        *[F.when(any_of(low, w), F.lit(r)) for w, r in ((CAPACITY_WORDS, "capacity"), (COST_WORDS, "cost"), (DEMAND_WORDS, "demand"))]
    )
    r = columns.where("is_numeric").select("dataset", "name", F.explode(F.filter(roles, lambda x: x.isNotNull())).alias("role"))
    return r


def weight_column(columns: DataFrame, requested: Column) -> DataFrame:
    """(dataset, weight_col): requested, common name, token, else null (uniform 1.0)."""
    low, req = F.lower("name"), F.lower(requested)
    head = F.substring(req, 1, 6)
    partial = low.startswith(head) | req.startswith(F.substring(low, 1, 6))
    common = _order_in(low, ("population", "pop", "demand", "weight"))
    c = columns.where("is_numeric and min_v >= 0")
    tier = (
        F.when(low == req, 1).when(partial, 2).when(common.isNotNull(), 3).when(any_of(low, WEIGHT_TOKENS), 4)
    )
    c = c.withColumn("_t", tier).where("_t is not null").withColumn("_c", F.when(F.col("_t") == 3, common).otherwise(0))
    best = _first(c, None, [F.col("_t"), F.col("_c"), F.col("ordinal")], "weight_col")
    return columns.select("dataset").distinct().join(best, "dataset", "left")


def hinted_weight_column(columns: DataFrame, lo: Column, hi: Column) -> DataFrame:
    """(dataset, weight_col, score): name words and a value range the user mentioned."""
    low = F.lower("name")
    score = sum((F.when(low.contains(w), 10).otherwise(0) for w in HINT_WORDS), F.lit(0))
    near = (F.abs(F.col("min_v") - lo) < 0.5) & (F.abs(F.col("max_v") - hi) < 0.5)
    holds = (F.col("min_v") <= lo) & (F.col("max_v") >= hi)
    score = score + F.when(near, 100).when(holds, 50).otherwise(0)
    c = columns.where(F.col("is_numeric") & ~any_of(low, HINT_EXCLUDED)).withColumn("score", score).where("score > 0")
    s = F.struct((-F.col("score")).alias("s"), "ordinal", "name")
    return c.groupBy("dataset").agg(F.min(s).alias("m")).select(
        "dataset", F.col("m.name").alias("weight_col"), (-F.col("m.s")).alias("score")
    )


def rank_per(df: DataFrame, keys, order, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
