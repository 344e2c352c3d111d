"""Solutions as GeoJSON lines, CSV rows, map layers and run records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import first_text


def _feature(geometry: Column, props: Column) -> Column:
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), props.alias("properties")))


def _point(x: Column, y: Column) -> Column:
    return F.struct(F.lit("Point").alias("type"), F.array(x, y).alias("coordinates"))


def _line(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(F.lit("LineString").alias("type"), F.array(F.array(x1, y1), F.array(x2, y2)).alias("coordinates"))


def geojson_features(selected: DataFrame, lines: DataFrame) -> DataFrame:
    """(kind, id, feature): one GeoJSON Feature per row, facilities and assignments.

    ``lines`` is the output of ``attach_points``.
    """
    extra = [c for c in ("name", "id", "capacity", "cost", "label") if c in selected.columns]
    fac = selected.select(
        F.lit("facility").alias("kind"), F.col("site_id").alias("id"),
        _feature(_point(F.col("lon"), F.col("lat")), F.struct(F.lit("facility").alias("kind"), F.col("site_id").alias("facility_idx"), *extra)).alias("feature"),
    )
    asg = lines.select(
        F.lit("assignment").alias("kind"), F.col("demand_id").alias("id"),
        _feature(_line(F.col("dx"), F.col("dy"), F.col("sx"), F.col("sy")),
                 F.struct(F.lit("assignment").alias("kind"), F.col("demand_id").alias("demand_idx"), F.col("site_id").alias("facility_idx"))).alias("feature"),
    )
    return fac.unionByName(asg)


def write_geojson(features: DataFrame, path: str) -> None:
    """Line-delimited GeoJSON; files stay splittable."""
    features.select("feature").write.text(path)


def _alias(df: DataFrame, names: Sequence[str]) -> Column:
    have = [F.col(n) for n in names if n in df.columns]
    return first_text(have) if have else F.lit(None).cast("string")


def facilities_csv(selected: DataFrame, assignments: DataFrame, keys: Sequence[str] = ("aoi_id",)) -> DataFrame:
    """Rows of the facilities file; coordinates with six decimals."""
    k = list(keys)
    n = assignments.groupBy(*k, "site_id").agg(F.count(F.lit(1)).alias("num_assigned_demands"))
    s = selected.join(n, [*k, "site_id"], "left")
    return s.select(
        F.col("site_id").alias("facility_idx"), _alias(selected, ("name", "label", "place_name")).alias("name"), _alias(selected, ("id", "site_id", "osm_id")).alias("id"),
        F.format_string("%.6f", F.col("lat")).alias("lat"), F.format_string("%.6f", F.col("lon")).alias("lon"),
        _alias(selected, ("capacity", "cap", "max_capacity")).try_cast("double").alias("capacity"),
        _alias(selected, ("cost", "fixed_cost", "facility_cost", "opening_cost")).try_cast("double").alias("cost"),
        F.coalesce("num_assigned_demands", F.lit(0).cast("bigint")).alias("num_assigned_demands"),
    )


def long_rows(selected: DataFrame, assignments: DataFrame, metrics: DataFrame, keys: Sequence[str] = ("aoi_id",)) -> DataFrame:
    """Facility, assignment and metric rows in one table."""
    k = list(keys)
    f = selected.select(*k, F.lit("facility").alias("type"), F.col("site_id").alias("index"), F.lit(True).alias("selected"))
    a = assignments.select(*k, F.lit("assignment").alias("type"), "demand_id", F.col("site_id").alias("facility_id"))
    names = [c for c in metrics.columns if c not in k]
    m = metrics.select(*k, F.inline(F.array(*[F.struct(F.lit(c).alias("metric_name"), F.col(c).cast("double").alias("value")) for c in names])))
    return f.unionByName(a, allowMissingColumns=True).unionByName(m.withColumn("type", F.lit("metric")), allowMissingColumns=True)


def map_layers(demand: DataFrame, candidates: DataFrame, selected: DataFrame, lines: DataFrame, surface: DataFrame, edges: DataFrame, keys: Sequence[str] = ("aoi_id",)) -> DataFrame:
    """(keys, role, id, x, y, x2, y2, props): every layer in one table, by role."""
    k = list(keys)

    def layer(df, role, id_, x, y, props, x2=None, y2=None):
        none = F.lit(None).cast("double")
        return df.select(
            *k, F.lit(role).alias("role"), F.col(id_).cast("bigint").alias("id"), F.col(x).alias("x"), F.col(y).alias("y"),
            F.col(x2).alias("x2") if x2 else none.alias("x2"), F.col(y2).alias("y2") if y2 else none.alias("y2"), F.to_json(F.struct(*props)).alias("props"),
        )

    parts = [
        layer(edges, "boundary", "seq", "x1", "y1", ["seq"], "x2", "y2"),
        layer(demand, "demand", "demand_id", "lon", "lat", [F.col("weight").alias("population")]),
        layer(candidates, "candidate", "site_id", "lon", "lat", ["capacity", "cost"]),
        layer(selected, "selected", "site_id", "lon", "lat", ["capacity", "cost"]),
        layer(lines, "assignment", "demand_id", "dx", "dy", ["weight", "site_id"], "sx", "sy"),
        layer(surface, "access_heatmap", "demand_id", "lon", "lat", ["weight", "dist_m"]),
        layer(surface.where("is_gap"), "gap", "demand_id", "lon", "lat", ["weight", "dist_m"]),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def run_manifest(run_id: Column, selected: DataFrame, counts: DataFrame, params: dict[str, str], keys: Sequence[str] = ("aoi_id",)) -> DataFrame:
    """One record per run: counts, parameters, objective and the chosen sites."""
    k = list(keys)
    ids = selected.groupBy(*k).agg(F.array_sort(F.collect_list("site_id")).alias("selected_ids"), F.count(F.lit(1)).alias("n_selected"))
    p = F.to_json(F.create_map(*[F.lit(v) for kv in params.items() for v in kv]))
    return counts.join(ids, k).select(run_id.alias("run_id"), *k, *[c for c in counts.columns if c not in k], "n_selected", "selected_ids", p.alias("params"))


def append_runs(manifest: DataFrame, path: str, run_date: str) -> None:
    """Append to the run log, partitioned by date; earlier records are never touched."""
    manifest.withColumn("run_date", F.lit(run_date)).write.mode("append").partitionBy("run_date").parquet(path)


def append_solution(solution: DataFrame, path: str) -> None:
    solution.write.mode("append").parquet(path)


def solution_versions(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """Latest version and number of versions per key."""
    h = spark.read.parquet(path)
    return h.groupBy(*keys).agg(F.max("version").alias("version"), F.count_distinct("version").alias("n_versions"))
