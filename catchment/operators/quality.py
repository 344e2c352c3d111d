"""Cleaning and checking of point data and boundaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def _in_range(lat: Column, lon: Column) -> Column:
    return (lat.between(-90, 90) & lon.between(-180, 180)).cast("double")


def sanitise_latlon(df: DataFrame, keys: Sequence[str], lat: str = "lat", lon: str = "lon", share: float = 0.95) -> DataFrame:
    """Cast, drop non-numbers, and swap the two columns of sources that mixed them up.

    ``verdict`` is ok, swapped or error per source; error rows keep their values.
    """
    k = list(keys)
    d = df.withColumn(lat, F.col(lat).try_cast("double")).withColumn(lon, F.col(lon).try_cast("double"))
    d = d.where(F.col(lat).isNotNull() & F.col(lon).isNotNull())
    rate = d.groupBy(*k).agg(F.avg(_in_range(F.col(lat), F.col(lon))).alias("_ok"), F.avg(_in_range(F.col(lon), F.col(lat))).alias("_sw"))
    verdict = F.when(F.col("_ok") >= share, "ok").when((F.col("_sw") > F.col("_ok")) & (F.col("_sw") >= share), "swapped").otherwise("error")
    d = d.join(rate.select(*k, verdict.alias("verdict")), k)
    swap = F.col("verdict") == "swapped"
    return d.withColumn("_a", F.when(swap, F.col(lon)).otherwise(F.col(lat))).withColumn("_b", F.when(swap, F.col(lat)).otherwise(F.col(lon))).drop(lat, lon).withColumnsRenamed({"_a": lat, "_b": lon})


def validate_points(df: DataFrame, keys: Sequence[str], lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Counts per source: rows, missing, out of range, duplicates of a coordinate."""
    x, y = F.col(lon), F.col(lat)
    missing = x.isNull() | y.isNull()
    # two plain aggregations: spots first, so repeated spots shrink before the second
    spots = df.groupBy(*keys, lon, lat).agg(F.count(F.lit(1)).alias("_n"))
    far = ~missing & ~(x.between(-180, 180) & y.between(-90, 90))
    zero = F.lit(0).cast("bigint")
    return spots.groupBy(*keys).agg(
        F.sum("_n").alias("n_rows"),
        F.coalesce(F.sum(F.when(missing, F.col("_n"))), zero).alias("n_missing"),
        F.coalesce(F.sum(F.when(far, F.col("_n"))), zero).alias("n_out_of_range"),
        F.coalesce(F.sum(F.when(~missing, F.col("_n") - 1)), zero).alias("n_duplicate"),
    )


# Rules for measures: what a missing and what a bad value becomes.
def measure_capacity(c: Column) -> Column:
    v = F.coalesce(c.try_cast("double"), F.lit(1.0))
    return F.when(v <= 0, F.greatest(v, F.lit(1.0))).otherwise(v)


def measure_cost(c: Column) -> Column:
    return F.greatest(F.coalesce(c.try_cast("double"), F.lit(0.0)), F.lit(0.0))


measure_demand = measure_cost


def default_weight(df: DataFrame, missing: float = 1.0) -> DataFrame:
    """Add or fill ``weight``; the value for missing rows is the caller's choice."""
    if "weight" not in df.columns:
        return df.withColumn("weight", F.lit(missing))
    return df.withColumn("weight", F.coalesce(F.col("weight").cast("double"), F.lit(missing)))


def column_stats(df: DataFrame, columns: Sequence[str], order: str, keys: Sequence[str] = ()) -> DataFrame:
    """Long table (keys, column, n, n_bad, first, mean, min, max) in one pass."""
    aggs = []
    for c in columns:
        n = F.col(c).try_cast("double")
        aggs += [
            F.count(c).alias(f"{c}__n"),
            F.count(F.when(F.col(c).isNotNull() & n.isNull(), 1)).alias(f"{c}__b"),
            F.min_by(F.col(c).cast("string"), F.when(F.col(c).isNotNull(), F.col(order))).alias(f"{c}__f"),
            F.avg(n).alias(f"{c}__m"), F.min(n).alias(f"{c}__lo"), F.max(n).alias(f"{c}__hi"),
        ]
    wide = df.groupBy(*keys).agg(*aggs)
    rows = [
        F.struct(
            F.lit(c).alias("column"), F.col(f"{c}__n").alias("n"), F.col(f"{c}__b").alias("n_bad"), F.col(f"{c}__f").alias("first"),
            F.col(f"{c}__m").alias("mean"), F.col(f"{c}__lo").alias("min"), F.col(f"{c}__hi").alias("max"),
        )
        for c in columns
    ]
    return wide.select(*keys, F.inline(F.array(*rows)))


def validate_boundary(edges: DataFrame, keys: Sequence[str] = ("aoi_id",)) -> DataFrame:
    """Box of each ring set and whether it can serve as a boundary."""
    b = edges.groupBy(*keys).agg(F.min("x1").alias("x0"), F.max("x1").alias("x1"), F.min("y1").alias("y0"), F.max("y1").alias("y1"), F.count(F.lit(1)).alias("n_edges"))
    ordered = (F.col("x0") < F.col("x1")) & (F.col("y0") < F.col("y1"))
    world = F.col("x0").between(-180, 180) & F.col("x1").between(-180, 180) & F.col("y0").between(-90, 90) & F.col("y1").between(-90, 90)
    return b.withColumn("valid", (F.col("n_edges") >= 3) & ordered & world)


# Areas a boundary must lie between, in km2.
MIN_AREA_KM2, MAX_AREA_KM2 = 0.5, 50_000.0


def area_gate(areas: DataFrame) -> DataFrame:
    a = F.col("area_km2")
    return areas.withColumn("reason", F.when(a < MIN_AREA_KM2, "too small").when(a > MAX_AREA_KM2, "too large"))


def synthetic_gate(sources: DataFrame, keys: Sequence[str], force: bool = False) -> DataFrame:
    """Blocked keys: any input row that says it is synthetic (unless forced)."""
    g = sources.groupBy(*keys).agg(F.bool_or(F.lower("data_source").contains("synthetic")).alias("synthetic"))
    return g.withColumn("blocked", F.col("synthetic") & F.lit(not force))


def facility_set_errors(sets: DataFrame, n_sites: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Errors in forced-open / forced-closed / existing sets, one row per (key, error).

    ``sets`` is long: (keys, kind, site_id), so a set may have any size.
    """
    k = list(keys)
    s = sets.join(n_sites, k, "left")
    bad = F.when(F.col("site_id") < 0, F.lit("negative id")).when(F.col("site_id") > F.col("max_site"), F.lit("id out of range"))
    single = s.select(*k, bad.alias("error")).where("error is not null").distinct()
    opened = sets.where("kind <> 'fixed_closed'").select(*k, "site_id").distinct()
    closed = sets.where("kind = 'fixed_closed'").select(*k, "site_id").distinct()
    clash = opened.join(closed, [*k, "site_id"], "left_semi").select(*k, F.lit("both open and closed").alias("error")).distinct()
    return single.unionByName(clash)


# What each model and variant needs, and the default where there is one.
SCENARIO_RULES = (
    ("p-median", "capacitated", "capacities", "warn"), ("p-median", "budget", "budget", "warn"),
    ("p-median", "budget", "facility_costs", "warn"), ("p-median", "max_distance", "max_assignment_distance", "warn"),
    ("p-center", "conditional", "existing_facilities", "error"), ("mclp", "*", "service_radius", "error"),
    ("mclp", "multi_coverage", "k_coverage", "2"), ("mclp", "backup", "k_coverage", "2"),
    ("lscp", "*", "service_radius", "error"), ("lscp", "conditional", "existing_facilities", "error"),
    ("lscp", "backup", "k_coverage", "2"), ("lscp", "probabilistic", "coverage_reliability", "0.95"),
    ("lscp", "partial", "coverage_fraction", "0.95"),
)


def scenario_findings(scenarios: DataFrame) -> DataFrame:
    """(scenario_id, parameter, action) for every missing parameter.

    ``scenarios`` has (scenario_id, problem, variant, given ARRAY<STRING>).  The
    rules are a literal of a dozen rows, tested inside the row.
    """
    rules = F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(r, ("p", "v", "need", "action"))]) for r in SCENARIO_RULES])
    hit = F.filter(
        rules,
        lambda r: (r["p"] == F.col("problem")) & ((r["v"] == "*") | (r["v"] == F.col("variant"))) & ~F.array_contains("given", r["need"]),
    )
    return scenarios.select("scenario_id", F.explode(hit).alias("r")).select("scenario_id", F.col("r.need").alias("parameter"), F.col("r.action").alias("action"))


# The variants of each model, and what a parameter may hold where it is read:
# model, variants (all where empty), parameter, whether it must be given, test of its number x, what is asked.
VARIANTS = {
    "p-median": ("base", "capacitated", "budget", "max_distance"),
    "p-center": ("vertex", "base", "weighted", "conditional"),
    "mclp": ("classical", "base", "budget", "capacitated", "probabilistic", "multi_coverage", "backup"),
    "lscp": ("base", "backup", "conditional", "probabilistic", "partial"),
}
VALUE_RULES = (
    ("p-median", (), "n_facilities", True, "x >= 1 and x = floor(x)", "a whole number from 1"),
    ("p-center", (), "n_facilities", True, "x >= 1 and x = floor(x)", "a whole number from 1"),
    ("mclp", ("classical", "base", "probabilistic", "multi_coverage", "backup"), "n_facilities", True, "x >= 1 and x = floor(x)", "a whole number from 1"),
    ("mclp", (), "service_radius", True, "x > 0", "more than 0"),
    ("lscp", (), "service_radius", True, "x > 0", "more than 0"),
    ("mclp", ("budget",), "budget", True, "x > 0", "more than 0"),
    ("p-median", ("budget",), "budget", False, "x > 0", "more than 0"),
    ("mclp", ("multi_coverage", "backup"), "k_coverage", False, "x >= 1 and x = floor(x)", "a whole number from 1"),
    ("lscp", ("backup",), "k_coverage", False, "x >= 1 and x = floor(x)", "a whole number from 1"),
    ("lscp", ("probabilistic",), "coverage_reliability", False, "x > 0 and x < 1", "between 0 and 1"),
    ("lscp", ("partial",), "coverage_fraction", False, "x > 0 and x <= 1", "more than 0, at most 1"),
)


def scenario_value_faults(scenarios: DataFrame) -> DataFrame:
    """(scenario_id, parameter, fault): a row for every unknown model or variant and every bad value.

    ``scenarios`` has (scenario_id, problem, variant) and any of the parameters, as text or
    number; a parameter it lacks is null.  A null variant is the model's first.  Faults:
    missing, not a number, or what the value must be.  NaN and infinities are not numbers.
    """
    known = F.create_map(*[x for m, v in VARIANTS.items() for x in (F.lit(m), F.array(*map(F.lit, v)))])
    allowed = F.try_element_at(known, F.col("problem"))
    variant = F.coalesce("variant", F.get(allowed, 0))
    found = [
        F.when(F.col("problem").isNull() | allowed.isNull(), F.struct(F.lit("problem").alias("parameter"), F.lit("unknown").alias("fault"))),
        F.when(allowed.isNotNull() & ~F.array_contains(allowed, variant), F.struct(F.lit("variant").alias("parameter"), F.lit("unknown").alias("fault"))),
    ]
    for model, variants, name, required, test, asked in VALUE_RULES:
        read = (F.col("problem") == model) & (variant.isin(*variants) if variants else F.lit(True))
        raw = F.trim(F.col(name).cast("string")) if name in scenarios.columns else F.lit(None).cast("string")
        x = raw.try_cast("double")
        ok = F.expr(f"transform(array(try_cast(trim(cast(`{name}` as string)) as double)), x -> {test})[0]") if name in scenarios.columns else F.lit(None).cast("boolean")
        whole = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
        fault = F.when(raw.isNull(), F.lit("missing") if required else F.lit(None)).when(~whole, F.lit("not a number")).when(~ok, F.lit(f"must be {asked}"))
        found.append(F.when(read & fault.isNotNull(), F.struct(F.lit(name).alias("parameter"), fault.alias("fault"))))
    either = [F.col(c).isNull() if c in scenarios.columns else F.lit(True) for c in ("n_facilities", "budget")]
    none = (F.col("problem") == "mclp") & (variant == "capacitated") & either[0] & either[1]
    found.append(F.when(none, F.struct(F.lit("n_facilities").alias("parameter"), F.lit("missing, and no budget").alias("fault"))))
    rows = scenarios.select("scenario_id", F.explode(F.filter(F.array(*found), lambda r: r.isNotNull())).alias("r"))
    return rows.select("scenario_id", "r.parameter", "r.fault")


def scenario_normalise(s: DataFrame) -> DataFrame:
    """Synonyms folded, variant tidied and dropped when its parameter is missing."""
    v = F.regexp_replace(F.lower(F.trim("variant")), "-", "_")
    base = F.when(F.col("problem") == "mclp", "classical").otherwise("base")
    out = s.select(
        "scenario_id", "problem", F.coalesce("service_radius", "service_distance", "distance_threshold").alias("service_radius"),
        F.coalesce("k_coverage", "k").alias("k_coverage"), F.coalesce("facility_reliability", "reliability").alias("facility_reliability"), "budget", v.alias("_v"),
    )
    lost = ((F.col("_v") == "budget") & F.col("budget").isNull()) | (F.col("_v").isin("multi_coverage", "backup") & F.col("k_coverage").isNull())
    return out.withColumn("variant", F.when(F.col("_v").isNull() | lost, base).otherwise(F.col("_v"))).drop("_v")
