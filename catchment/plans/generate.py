"""Made-up demand and candidates inside given areas, and thinning of points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.coverage import pairs_within
from ..operators.measures import top_n
from ..operators.running import running_totals
from ..session import materialize

# People per km2 where nothing is known, and the last resort.
PEOPLE_PER_KM2, DEFAULT_POPULATION = 250.0, 100_000

# edges of a ring that one task cuts, height of a band in degrees, parts an area is shared in, points of a row of a plan
BAND_EDGES, SPHERE_BAND, SHARES, RUN = 64, 0.25, float(1 << 44), 4096


def estimate_population(stated: Column, area_km2: Column) -> Column:
    n = F.floor(F.regexp_replace(stated, ",", "").try_cast("double")).cast("bigint")
    by_area = F.floor(area_km2 * PEOPLE_PER_KM2).cast("bigint")
    return F.when(n > 0, n).when(by_area > 0, by_area).otherwise(F.lit(DEFAULT_POPULATION).cast("bigint"))


def _unit(*cols) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 40)) / float(1 << 40)


def trapezoids(edges: DataFrame, keys: Sequence[str] = ("aoi_id",), sphere: bool = False) -> DataFrame:
    """Areas cut into horizontal trapezoids: (keys, band, y0, no, y1, xl0, xl1, xr0, xr1, w0, w1, area).

    ``edges`` are those of all rings of a key, inside by even-odd crossings.  A key is first cut into
    bands of about ``BAND_EDGES`` edges, so no task ever holds a whole ring; within a band the
    ordinates of the corners cut it into slabs, and the edges of a slab pair up from the left.
    ``w0`` and ``w1`` are the widths at both ends; with ``sphere`` they carry the cosine of
    the latitude and bands are at most ``SPHERE_BAND`` degrees high, which keeps density
    within 3e-6 of uniform by area.
    """
    k = list(keys)
    box = edges.groupBy(*k).agg(
        F.least(F.min("y1"), F.min("y2")).alias("_lo"), F.greatest(F.max("y1"), F.max("y2")).alias("_hi"), F.count(F.lit(1)).alias("_n")
    ).where("_lo < _hi")
    parts = F.ceil(F.col("_n") / BAND_EDGES)
    if sphere:
        parts = F.greatest(parts, F.ceil((F.col("_hi") - F.col("_lo")) / SPHERE_BAND))
    box = box.withColumn("_parts", F.greatest(F.lit(1).cast("bigint"), parts)).withColumn("_dy", (F.col("_hi") - F.col("_lo")) / F.col("_parts"))
    e = edges.where("y1 <> y2").select(
        *k, F.least("y1", "y2").alias("ya"), F.greatest("y1", "y2").alias("yb"),
        F.when(F.col("y1") < F.col("y2"), F.col("x1")).otherwise(F.col("x2")).alias("xa"),
        F.when(F.col("y1") < F.col("y2"), F.col("x2")).otherwise(F.col("x1")).alias("xb"),
    ).join(box, k)
    # one band more on either side: the exact test is the one against the slab
    first = F.greatest(F.lit(0).cast("bigint"), F.floor((F.col("ya") - F.col("_lo")) / F.col("_dy")) - 1)
    last = F.least(F.col("_parts") - 1, F.floor((F.col("yb") - F.col("_lo")) / F.col("_dy")) + 1)
    e = e.withColumn("band", F.explode(F.sequence(first, last)))
    top = F.when(F.col("band") + 1 == F.col("_parts"), F.col("_hi")).otherwise(F.col("_lo") + (F.col("band") + 1) * F.col("_dy"))
    e = e.withColumns({"_b0": F.col("_lo") + F.col("band") * F.col("_dy"), "_b1": top})
    kb = [*k, "band"]
    cuts = e.select(*kb, "_b0", "_b1", F.explode(F.array("ya", "yb", "_b0", "_b1")).alias("y0")).where("y0 between _b0 and _b1")
    cuts = cuts.select(*kb, "y0").distinct()
    slabs = cuts.withColumn("y1", F.lead("y0").over(Window.partitionBy(*kb).orderBy("y0"))).where("y1 is not null")
    in_slab = e.select(*kb, "xa", "xb", "ya", "yb").join(slabs, kb).where("ya <= y0 and yb >= y1")

    def x_at(y: str) -> Column:
        return F.col("xa") + (F.col(y) - F.col("ya")) / (F.col("yb") - F.col("ya")) * (F.col("xb") - F.col("xa"))

    walls = in_slab.select(*kb, "y0", "y1", x_at("y0").alias("xl0"), x_at("y1").alias("xl1"))
    w = Window.partitionBy(*kb, "y0").orderBy(F.col("xl0") + F.col("xl1"), "xl0")
    walls = walls.withColumns({"no": F.row_number().over(w), "xr0": F.lead("xl0").over(w), "xr1": F.lead("xl1").over(w)})
    shrink = (lambda y: F.cos(F.radians(y))) if sphere else (lambda y: F.lit(1.0))
    t = walls.where("no % 2 = 1 and xr0 is not null").withColumns({
        "w0": F.greatest(F.lit(0.0), F.col("xr0") - F.col("xl0")) * shrink("y0"),
        "w1": F.greatest(F.lit(0.0), F.col("xr1") - F.col("xl1")) * shrink("y1"),
    })
    return t.withColumn("area", (F.col("w0") + F.col("w1")) / 2 * (F.col("y1") - F.col("y0")))


def points_in_areas(
    counts: DataFrame, edges: DataFrame, keys: Sequence[str] = ("aoi_id",), seed: int = 42, sphere: bool = False
) -> DataFrame:
    """(keys, point_no, lon, lat): exactly ``n`` points per area, spread evenly over its polygon.

    ``counts`` has (keys, n).  Nothing is drawn and thrown away: every trapezoid gets its share of
    the n points by running totals of whole numbers, so the shares add up to n however thin the
    area is, and places inside it are hashes of (key, point), so a lost task
    draws the same points again.  With ``sphere`` points are even by area on
    the globe.  Areas without extent get none; ``draw_status`` names them.
    """
    k = list(keys)
    cut = materialize(trapezoids(edges, k, sphere), "trapezoids")
    whole = cut.groupBy(*k).agg(F.sum("area").alias("_area")).where("_area > 0")
    cut = cut.join(whole, k).withColumn("_mass", F.floor(F.col("area") / F.col("_area") * SHARES).cast("bigint")).where("_mass > 0")
    run = running_totals(cut, k, "band", ["_mass"], width=1.0, tie=["y0", "no"], levels=2)
    mass = cut.groupBy(*k).agg(F.sum("_mass").alias("_all"))
    shift = F.floor(_unit(F.lit(seed), *[F.col(x) for x in k]) * F.col("_all"))

    def points_below(c: Column) -> Column:
        total = c.cast("decimal(19,0)") * F.col("n").cast("decimal(18,0)") + F.col("_shift")
        return F.floor((total - total % F.col("_all")) / F.col("_all")).cast("bigint")

    run = run.join(mass, k).join(counts.select(*k, F.col("n").cast("bigint").alias("n")), k).withColumn("_shift", shift)
    run = run.withColumns({"_to": points_below(F.col("cum__mass")), "_from": points_below(F.col("cum__mass") - F.col("_mass"))})
    run = run.where("_to > _from").withColumn("_at", F.explode(F.expr(f"sequence(_from, _to - 1, {RUN}L)")))
    pts = run.withColumn("point_no", F.explode(F.sequence(F.col("_at") + 1, F.least(F.col("_at") + RUN, F.col("_to")))))
    u = _unit(F.lit(seed), *[F.col(x) for x in k], F.col("point_no"), F.lit("x"))
    v = _unit(F.lit(seed), *[F.col(x) for x in k], F.col("point_no"), F.lit("y"))
    # share of the height below which a part v of the trapezoid lies
    t = v * (F.col("w0") + F.col("w1")) / (F.col("w0") + F.sqrt(F.greatest(F.lit(0.0), F.col("w0") * F.col("w0") * (1 - v) + F.col("w1") * F.col("w1") * v)))
    pts = pts.withColumns({"_t": F.when(v > 0, t).otherwise(0.0), "_u": u})
    left = F.col("xl0") + F.col("_t") * (F.col("xl1") - F.col("xl0"))
    right = F.col("xr0") + F.col("_t") * (F.col("xr1") - F.col("xr0"))
    return pts.select(
        *k, "point_no", (left + F.col("_u") * (right - left)).alias("lon"), (F.col("y0") + F.col("_t") * (F.col("y1") - F.col("y0"))).alias("lat")
    )


def draw_status(counts: DataFrame, edges: DataFrame, keys: Sequence[str] = ("aoi_id",)) -> DataFrame:
    """(keys, n, status): whether ``points_in_areas`` can draw: 'ok', 'no extent' or 'no boundary'."""
    k = list(keys)
    area = trapezoids(edges, k).groupBy(*k).agg(F.sum("area").alias("_area"))
    known = edges.select(*k).distinct().withColumn("_known", F.lit(True))
    status = F.when(F.col("_known").isNull(), "no boundary").when(F.coalesce("_area", F.lit(0.0)) > 0, "ok").otherwise("no extent")
    return counts.join(known, k, "left").join(area, k, "left").select(*k, "n", status.alias("status"))


def synthetic_demand(counts: DataFrame, edges: DataFrame, population: DataFrame, keys: Sequence[str] = ("aoi_id",), seed: int = 42) -> DataFrame:
    """Points spread evenly that share the stated population evenly."""
    k = list(keys)
    pts = points_in_areas(counts, edges, k, seed)
    return pts.join(counts.select(*k, F.col("n").alias("_n")), k).join(population, k).select(
        *k, F.col("point_no").alias("demand_id"), "lon", "lat", (F.col("population") / F.col("_n")).alias("weight"), F.lit("synthetic_uniform_grid").alias("data_source")
    )


def thin_points(
    points: DataFrame, target: int, keys: Sequence[str] = ("aoi_id",), point_id: str = "site_id",
    start_m: float = 200.0, doublings: int = 8, seed: int = 42,
) -> DataFrame:
    """At most ``target`` points per key, spread out.

    A hash gives every point a priority; a point stays when it has the lowest
    priority around it, its neighbours go, until none is undecided.  The spacing
    doubles while a key still has too many; what is left over after that is cut
    to the lowest priorities.
    """
    k = list(keys)
    pri = points.select(*k, point_id, "lon", "lat").withColumn("_p", F.xxhash64(F.lit(seed), F.col(point_id)))
    # copies at one spot are never both kept
    cur = pri.groupBy(*k, "lon", "lat").agg(F.min(F.struct("_p", point_id)).alias("m")).select(*k, "lon", "lat", "m._p", f"m.{point_id}")
    cur = materialize(cur, "thin")
    step = start_m
    for _ in range(doublings + 1):
        many = cur.groupBy(*k).count().where(F.col("count") > target).select(*k)
        work = materialize(cur.join(many, k, "left_semi"), "thin")
        if work.isEmpty():
            break
        kept = _independent(work, step, k, point_id)
        cur = materialize(cur.join(many, k, "left_anti").unionByName(kept), "thin")
        step *= 2
    return top_n(cur, k, [F.asc("_p"), F.asc(point_id)], target).select(*k, point_id, "lon", "lat")


def _independent(work: DataFrame, step: float, k: list[str], point_id: str) -> DataFrame:
    """Maximal set of points pairwise more than ``step`` apart, by parallel rounds."""
    a = work.select(*k, F.col(point_id).alias("i"), F.col("_p").alias("pi"), "lon", "lat")
    b = work.select(*k, F.col(point_id).alias("j"), F.col("_p").alias("pj"), "lon", "lat")
    near = materialize(pairs_within(a, b, step, k).where("i <> j").select(*k, "i", "pi", "j", "pj"), "near")
    undecided = materialize(work.select(*k, F.col(point_id).alias("i")), "undecided")
    kept = None
    while True:
        live = near.join(undecided, [*k, "i"], "left_semi").join(undecided.withColumnRenamed("i", "j"), [*k, "j"], "left_semi")
        beaten = live.where((F.col("pj") < F.col("pi")) | ((F.col("pj") == F.col("pi")) & (F.col("j") < F.col("i")))).select(*k, "i").distinct()
        win = materialize(undecided.join(beaten, [*k, "i"], "left_anti"), "kept")
        if win.isEmpty():
            break
        kept = win if kept is None else kept.unionByName(win)
        gone = near.join(win, [*k, "i"], "left_semi").select(*k, F.col("j").alias("i")).distinct()
        undecided = materialize(undecided.join(win, [*k, "i"], "left_anti").join(gone, [*k, "i"], "left_anti"), "undecided")
    return work.join(kept.withColumnRenamed("i", point_id), [*k, point_id], "left_semi")


def padded_outline(hull: DataFrame, keys: Sequence[str] = ("aoi_id",), share: float = 0.05, least_m: float = 500.0) -> DataFrame:
    """Hull corners moved away from the middle of their box, so every point keeps a margin."""
    from ..functions.geo import M_PER_DEG

    k = list(keys)
    b = hull.groupBy(*k).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    h = hull.join(b, k).withColumn("cx", (F.col("x0") + F.col("x1")) / 2).withColumn("cy", (F.col("y0") + F.col("y1")) / 2)
    per_x = F.cos(F.radians("cy")) * M_PER_DEG
    dx, dy = (F.col("x") - F.col("cx")) * per_x, (F.col("y") - F.col("cy")) * M_PER_DEG
    extent = F.greatest((F.col("x1") - F.col("x0")) * per_x, (F.col("y1") - F.col("y0")) * M_PER_DEG)
    pad = F.greatest(extent * share, F.lit(least_m))
    # a corner at distance r moves to r + pad; scaling by at least (1 + pad / half diagonal) keeps all points inside
    r = F.sqrt(dx * dx + dy * dy)
    f = F.when(r > 0, 1 + pad / r).otherwise(F.lit(1.0))
    return h.select(*k, "seq", (F.col("cx") + (F.col("x") - F.col("cx")) * f).alias("x"), (F.col("cy") + (F.col("y") - F.col("cy")) * f).alias("y"))
