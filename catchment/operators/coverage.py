"""Range joins: pairs within a radius, found through grid cells.

The demand side stays one row per point; each site is copied into the few cells
its radius touches.  Cells holding very many points are split with a salt that
both sides carry, so no task sees more than a bounded share of one cell.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import geo

# points of one cell handled together; a hotter cell is split, as its pairs grow with the square of a crowd
HOT_CELL = 4_000
# cells whose points are held in one list, for circles that cross some of them
RIM_CELLS = 4


def _band_cells(band: Column, deg: float) -> Column:
    """How many cells a latitude band is cut into; fewer towards the poles."""
    edge = F.greatest(F.abs(band * deg - 90.0), F.abs((band + 1) * deg - 90.0))
    c = F.cos(F.radians(F.least(F.lit(90.0), edge)))
    return F.greatest(F.lit(1).cast("bigint"), F.floor(c * (360.0 / deg)))


def _geo_cells(radius_m: float):
    deg = math.degrees(radius_m / geo.EARTH_RADIUS_M) * (1 + 1e-9) + 1e-9
    sin_r = math.sin(min(math.pi / 2, radius_m / geo.EARTH_RADIUS_M))

    def own(x: Column, y: Column) -> tuple[Column, Column]:
        band = F.floor((y + 90.0) / deg)
        n = _band_cells(band, deg)
        return band, F.pmod(F.floor((x + 180.0) / (F.lit(360.0) / n)), n)

    def touched(df: DataFrame, x: str, y: str) -> DataFrame:
        b = F.floor((F.col(y) + 90.0) / deg)
        df = df.withColumn("_b", F.explode(F.sequence(b - 1, b + 1)))
        n = _band_cells(F.col("_b"), deg)
        near_pole = F.abs(F.col(y)) + deg >= 90.0
        reach = F.when(near_pole, F.lit(180.0)).otherwise(
            F.degrees(F.asin(F.least(F.lit(1.0), sin_r / F.cos(F.radians(F.col(y)))))) + 1e-9
        )
        df = df.withColumn("_n", n).withColumn("_r", reach)
        step = F.lit(360.0) / F.col("_n")
        lo = F.floor((F.col(x) + 180.0 - F.col("_r")) / step)
        hi = F.floor((F.col(x) + 180.0 + F.col("_r")) / step)
        wrapped = F.array_distinct(F.transform(F.sequence(lo, hi), lambda i: F.pmod(i, F.col("_n"))))
        return df.withColumn("_c", F.explode(wrapped)).drop("_n", "_r")

    return own, touched


def _planar_cells(radius: float):
    def own(x: Column, y: Column) -> tuple[Column, Column]:
        return F.floor(y / radius), F.floor(x / radius)

    def touched(df: DataFrame, x: str, y: str) -> DataFrame:
        b, c = own(F.col(x), F.col(y))
        return df.withColumn("_b", F.explode(F.sequence(b - 1, b + 1))).withColumn(
            "_c", F.explode(F.sequence(c - 1, c + 1))
        )

    return own, touched


def salted(left: DataFrame, right: DataFrame, cell: Sequence[str], hot_cell: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with a ``_salt``: rows of a hot cell on the left are dealt over parts, those on the right are in each part."""
    # a row for ``hot_cell`` rows on the left at most, so it is small beside them; without it both sides would be shuffled once more
    hot = F.broadcast(
        left.groupBy(*cell).count().where(F.col("count") > hot_cell)
        .select(*cell, F.ceil(F.col("count") / hot_cell).alias("_parts"))
    )
    one = F.lit(1).cast("bigint")
    # a hash, not a random number: a task that runs again must send rows the same way
    spread = F.pmod(F.xxhash64(*[c for c in left.columns if c not in ("_b", "_c")]), F.coalesce("_parts", one))
    left = left.join(hot, list(cell), "left").withColumn("_salt", spread).drop("_parts")
    right = right.join(hot, list(cell), "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("_parts", one) - 1))
    ).drop("_parts")
    return left, right


def dealt(df: DataFrame, *cols: str) -> DataFrame:
    """``df`` by hash over two tasks a core: few rows that cost much work each would else share one task."""
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism, *cols)


def _ends(name: str, x: Column, y: Column) -> dict[str, Column]:
    """A point's place in space and the cosine of its latitude."""
    return {f"{name}{i}": c for i, c in enumerate(geo.Haversine.embed(x, y))} | {f"{name}c": F.cos(F.radians(y))}


def pairs_within(
    demand: DataFrame,
    sites: DataFrame,
    radius_m: float,
    keys: Sequence[str] = ("aoi_id",),
    metric=geo.Haversine,
    x: str = "lon",
    y: str = "lat",
    hot_cell: int = HOT_CELL,
    exact: bool = True,
) -> DataFrame:
    """All (demand, site) pairs of one key at most ``radius_m`` apart, inclusive.

    Site columns other than the keys come back with their own names, site
    coordinates as ``site_x`` / ``site_y``.  With ``exact=False`` the distance
    is left out and the caller filters.
    """
    k = list(keys)
    reach = radius_m + 0.002
    own, touched = (_geo_cells if metric is geo.Haversine else _planar_cells)(reach)
    b, c = own(F.col(x), F.col(y))
    left = demand.withColumn("_b", b).withColumn("_c", c)
    right = touched(dealt(sites.withColumnsRenamed({x: "site_x", y: "site_y"}), *k, "site_x", "site_y"), "site_x", "site_y")
    cell = [*k, "_b", "_c"]
    near = metric is geo.Haversine and exact
    if near:  # what depends on one end alone is not computed once a pair
        left = left.withColumns(_ends("_l", F.col(x), F.col(y)))
        right = right.withColumns(_ends("_r", F.col("site_x"), F.col("site_y")))
    left, right = salted(left, right, cell, hot_cell)
    # a key that is one constant would drop out of the join's columns, and both sides be dealt anew by their bytes
    left = left.withColumns({c: F.when(F.col("_b").isNotNull(), F.col(c)) for c in k})
    # few bytes that make many pairs: dealt by number, as they would be taken for one task's work
    parts = 2 * left.sparkSession.sparkContext.defaultParallelism
    left, right = (side.repartition(parts, *cell, "_salt") for side in (left, right))
    # copied sites are many more than the planner reckons, which takes their table's bytes: never broadcast
    pairs = left.join(right.hint("merge"), [*cell, "_salt"]).drop("_b", "_c", "_salt")
    if not exact:
        return pairs
    if near:
        at = [[F.col(f"{side}{i}") for i in range(3)] for side in ("_l", "_r")]
        pairs = pairs.where(metric.order(*at) <= metric.reach(radius_m + 0.01) ** 2)
        d = geo.mm(geo.haversine_m(F.col(x), F.col(y), F.col("site_x"), F.col("site_y"), F.col("_lc"), F.col("_rc")))
    else:
        d = metric.dist(F.col(x), F.col(y), F.col("site_x"), F.col("site_y"))
    pairs = pairs.withColumn("dist_m", d).where(F.col("dist_m") <= radius_m)
    return pairs.drop(*[f"{side}{c}" for side in ("_l", "_r") for c in "012c"])


def pairs_within_own(
    demand: DataFrame,
    sites: DataFrame,
    reach: str,
    keys: Sequence[str] = ("aoi_id",),
    metric=geo.Haversine,
) -> DataFrame:
    """Pairs of one key no further apart than the demand row's own column ``reach``.

    Demand is sorted into levels whose reach differs by at most a factor of two,
    and each level gets a grid of its own size, so a wide reach never coarsens
    the grid of a narrow one.  Rows without a positive reach have no pairs; reaches
    below a metre share one level.
    """
    half_way_round = math.pi * geo.EARTH_RADIUS_M
    level = F.greatest(F.lit(0.0), F.ceil(F.log2(reach))).cast("int")
    d = demand.where(F.col(reach) > 0).withColumn("_level", level)
    out = None
    for (n,) in sorted(map(tuple, d.select("_level").distinct().collect())):  # one row a power of two
        wide = 2.0**n if metric is not geo.Haversine else min(2.0**n, half_way_round)
        part = pairs_within(d.where(F.col("_level") == n).drop("_level"), sites, wide, keys, metric)
        part = part.where(F.col("dist_m") <= F.col(reach))
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = pairs_within(d.drop("_level"), sites, 1.0, keys, metric)
    return out


def _fine_cells(widest_m: float, fine: int):
    """Cells a ``fine``-th of the widest reach high, and the runs of them that a centre's circle touches."""
    deg = math.degrees(widest_m / geo.EARTH_RADIUS_M) / fine + 1e-9

    def own(x: Column, y: Column) -> tuple[Column, Column]:
        band = F.floor((y + 90.0) / deg)
        n = _band_cells(band, deg)
        return band, F.pmod(F.floor((x + 180.0) / (F.lit(360.0) / n)), n)

    def touched(df: DataFrame, reach: str) -> DataFrame:
        """``df`` per band and block of cells (_b, _kind, _g): cells _lo to _hi of the band are touched, _from to _to lie wholly in reach.

        Kind 0 are blocks of ``fine`` cells that hold some wholly in reach, kind 1 blocks of ``RIM_CELLS`` that hold some of the others.
        """
        x, y, r = F.col("site_x"), F.col("site_y"), F.col(reach) + 0.002
        far = F.degrees(r / geo.EARTH_RADIUS_M) * (1 + 1e-9) + 1e-9
        df = df.withColumn("_b", F.explode(F.sequence(F.floor((y - far + 90.0) / deg), F.floor((y + far + 90.0) / deg))))
        df = df.withColumn("_n", _band_cells(F.col("_b"), deg))
        step = F.lit(360.0) / F.col("_n")
        # no point of a cell is further from its middle than half its height plus half its widest side
        mid = (F.col("_b") + 0.5) * deg - 90.0
        low = F.greatest(F.lit(0.0), F.abs(mid) - deg / 2)
        slack = geo.M_PER_DEG * (deg / 2 + 180.0 / F.col("_n") * F.cos(F.radians(F.least(F.lit(90.0), low)))) + 0.01
        tall, flat = F.sin(F.radians(mid - y) / 2.0), F.cos(F.radians(y)) * F.cos(F.radians(mid))
        df = df.withColumn("_tall", tall * tall).withColumn("_flat", flat).withColumn("_slack", slack)

        def run(m: Column, unsure: float) -> list[Column]:
            """First and last cell whose middle is within ``m`` metres, not yet taken modulo the band; ``unsure`` is their share where cosines vanish."""
            h = F.sin(F.least(F.lit(math.pi / 2), m / (2 * geo.EARTH_RADIUS_M)))
            part = F.when(F.col("_flat") < 1e-12, F.lit(unsure)).otherwise((h * h - F.col("_tall")) / F.col("_flat"))
            wide = F.degrees(F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), part))))) * 2.0
            at = (x + 180.0) / step - 0.5
            lo = F.ceil(at - wide / step)
            hi = F.least(F.floor(at + wide / step), lo + F.col("_n") - 1)
            return [lo, F.when((m > 0) & (part >= 0), hi).otherwise(lo - 1)]

        outer, inner = run(F.col(reach) + F.col("_slack"), 1.0), run(F.col(reach) - F.col("_slack"), -1.0)
        df = df.withColumns(dict(zip(("_lo", "_hi", "_from", "_to"), [*outer, *inner], strict=True))).drop("_tall", "_flat", "_slack")
        # a run that passes the end of the band goes on at its start; a null where there is none, as a filter would work all this out twice
        turns = F.when(F.col("_lo") <= F.col("_hi"), F.sequence(F.floor(F.col("_lo") / F.col("_n")), F.floor(F.col("_hi") / F.col("_n"))))
        df = df.withColumn("_turn", F.explode(turns)).withColumn("_turn", F.col("_turn") * F.col("_n"))
        low, high = F.greatest(F.col("_lo") - F.col("_turn"), F.lit(0).cast("bigint")), F.least(F.col("_hi") - F.col("_turn"), F.col("_n") - 1)
        df = df.withColumns({"_lo": low, "_hi": high, "_from": F.col("_from") - F.col("_turn"), "_to": F.col("_to") - F.col("_turn")})
        df = df.withColumns({"_from": F.greatest("_lo", "_from"), "_to": F.least("_hi", "_to")})
        lo, hi, first, last = (F.col(c) for c in ("_lo", "_hi", "_from", "_to"))

        def blocks(kind: int, size: int, a: Column, b: Column) -> Column:
            run = F.transform(F.sequence(F.floor(a / size), F.floor(b / size)), lambda g: F.struct(F.lit(kind).alias("_kind"), g.alias("_g")))
            return F.when(a <= b, run).otherwise(F.array().cast("array<struct<_kind:int,_g:bigint>>"))

        some = first <= last
        inner = F.concat(blocks(0, fine, first, last), F.array_union(blocks(1, RIM_CELLS, lo, first - 1), blocks(1, RIM_CELLS, last + 1, hi)))
        return df.select("*", F.inline(F.when(some, inner).otherwise(blocks(1, RIM_CELLS, lo, hi)))).drop("_n", "_turn")

    return own, touched


def rows_in_reach(
    points: DataFrame,
    centres: DataFrame,
    reach: str,
    widest_m: float,
    keys: Sequence[str],
    state: Sequence[str],
    sums: Sequence[str],
    fine: int,
    hot_cell: int = HOT_CELL,
) -> DataFrame:
    """Rows (columns of ``centres``, state, sums) whose sums per centre are those over all points within its ``reach``.

    Cells that lie wholly in reach come as one row for each ``state`` they hold; only
    points of cells that the circle crosses are looked at one by one, so the work of a
    centre grows with its rim, not with the points it reaches.  A centre is copied once
    a block of cells and meets there a list of the block's cells or points.
    """
    k = list(keys)
    own, touched = _fine_cells(widest_m + 0.002, fine)
    b, c = own(F.col("lon"), F.col("lat"))
    left = points.select(*k, "lon", "lat", *state, *sums).withColumn("_b", b).withColumn("_c", c).where("_b is not null and _c is not null")
    block = [*k, "_b", "_kind", "_g"]
    at = touched(dealt(centres.withColumnsRenamed({"lon": "site_x", "lat": "site_y"}), *k, "site_x", "site_y"), reach)

    def square(m: Column) -> Column:
        """Of the chord of an arc of ``m`` metres."""
        h = F.sin(F.least(F.lit(math.pi / 2), m / (2 * geo.EARTH_RADIUS_M))) * (2 * geo.EARTH_RADIUS_M)
        return F.when(m > 0, h * h).otherwise(F.lit(-1.0))

    place = dict(zip(["_l0", "_l1", "_l2"], geo.Haversine.embed(F.col("lon"), F.col("lat")), strict=True))
    cells = left.groupBy(*k, "_b", "_c", *state).agg(*[F.sum(s).alias(s) for s in sums])
    cells = cells.withColumns({"_kind": F.lit(0), "_g": F.floor(F.col("_c") / fine), **{p: F.lit(None).cast("double") for p in ("lon", "lat", *place)}})
    spots = left.withColumns({"_kind": F.lit(1), "_g": F.floor(F.col("_c") / RIM_CELLS), **place})
    both, at = salted(spots.unionByName(cells), at, block, hot_cell)
    held = [F.col(s).alias(f"_s{i}") for i, s in enumerate([*state, *sums])]
    lists = both.groupBy(*block, "_salt").agg(F.collect_list(F.struct("_c", *[F.col(p).alias(f"_{p}") for p in ("lon", "lat", *place)], *held)).alias("_all"))
    # copied centres are many more than the planner reckons, which takes their table's bytes: never broadcast
    met = at.join(lists.hint("merge"), [*block, "_salt"]).select(*[c for c in at.columns if c not in (*block, "_salt") or c in k], F.inline("_all"))
    inside = F.col("_c").between(F.col("_from"), F.col("_to"))
    chord = geo.Haversine.order(geo.Haversine.embed(F.col("site_x"), F.col("site_y")), [F.col(f"__l{i}") for i in range(3)])
    d = geo.Haversine.dist(F.col("_lon"), F.col("_lat"), F.col("site_x"), F.col("site_y"))
    # the distance itself is worked out where the chord does not tell
    near = (chord <= square(F.col(reach) - 0.01)) | ((chord <= square(F.col(reach) + 0.01)) & (d <= F.col(reach)))
    met = met.where(F.col("_c").between(F.col("_lo"), F.col("_hi")) & F.when(F.col("_lon").isNull(), inside).otherwise(~inside & near))
    names = [F.col({"lon": "site_x", "lat": "site_y"}.get(c, c)).alias(c) for c in centres.columns]
    return met.select(*names, *[F.col(f"_s{i}").alias(s) for i, s in enumerate([*state, *sums])])


def rim_cells(points: DataFrame, widest_m: float, keys: Sequence[str]) -> int:
    """How fine ``rows_in_reach`` should cut: cells and rim points of a circle then cost about the same."""
    own, _ = _fine_cells(widest_m + 0.002, 1)
    b, c = own(F.col("lon"), F.col("lat"))
    held = points.groupBy(*keys, b.alias("_b"), c.alias("_c")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    crowd = held.agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).first()[0] or 1.0
    return max(2, min(32, round(crowd ** (1 / 3))))


def beside(rows: DataFrame, marks: DataFrame, radius_m: float, keys: Sequence[str]) -> DataFrame:
    """Rows in a cell that lies within ``radius_m`` of a mark: all rows that near and some further off, once each."""
    own, touched = _geo_cells(radius_m + 0.002)
    b, c = own(F.col("lon"), F.col("lat"))
    cells = touched(marks.select(*keys, "lon", "lat"), "lon", "lat").select(*keys, "_b", "_c")
    return rows.withColumn("_b", b).withColumn("_c", c).join(cells, [*keys, "_b", "_c"], "left_semi").drop("_b", "_c")


def peaks(rows: DataFrame, radius_m: float, keys: Sequence[str], name: str, rank: str) -> DataFrame:
    """(keys, name): those of the greatest ``rank`` among all rows within ``radius_m`` of any of their rows."""
    k = list(keys)
    # cells of a third: everything in one is within the radius, so who is not first there is no peak
    own, _ = _geo_cells(radius_m / 3)
    b, c = own(F.col("lon"), F.col("lat"))
    r = rows.select(*k, name, "lon", "lat", F.col(rank).alias("_r"))
    first = r.groupBy(*k, b.alias("_b"), c.alias("_c")).agg(F.max(F.struct("_r", name)).alias("_m")).select(*k, F.col(f"_m.{name}").alias(name)).distinct()
    mine = r.join(first, [*k, name]).select(*k, F.col(name).alias("_name"), "lon", "lat", F.col("_r").alias("_mine"))
    around = pairs_within(r.drop(name), mine, radius_m, k)
    top = around.groupBy(*k, F.col("_name").alias(name)).agg(F.max("_r").alias("_top"), F.min("_mine").alias("_mine"))
    return top.where(F.col("_top") == F.col("_mine")).select(*k, name)


def coverage_pairs(demand: DataFrame, sites: DataFrame, radius_m: float, keys=("aoi_id",), metric=geo.Haversine) -> DataFrame:
    """Sparse coverage relation: absent rows are the zeros of the matrix."""
    d = demand.select(*keys, "demand_id", "lon", "lat")
    s = sites.select(*keys, "site_id", "lon", "lat")
    return pairs_within(d, s, radius_m, keys, metric).select(*keys, "demand_id", "site_id", "dist_m")


def geodesic_pairs(demand: DataFrame, sites: DataFrame, radius_m: float, keys=("aoi_id",)) -> DataFrame:
    """Pairs within a radius on the ellipsoid; the sphere differs by less than 0.7 %."""
    wide = coverage_pairs_wide(demand, sites, radius_m * 1.007, keys)
    ends = [F.col(c) for c in ("lon", "lat", "site_x", "site_y")]
    d = geo.geodesic_m(*ends, F.col("_v"))
    return wide.withColumn("_v", geo.ellipsoid_once(*ends)).withColumn("dist_m", F.round(d, 3)).where(F.col("dist_m") <= radius_m).select(
        *keys, "demand_id", "site_id", "dist_m"
    )


def coverage_pairs_wide(demand, sites, radius_m, keys=("aoi_id",)) -> DataFrame:
    d = demand.select(*keys, "demand_id", "lon", "lat")
    s = sites.select(*keys, "site_id", "lon", "lat")
    return pairs_within(d, s, radius_m, keys)


def cover_counts(demand: DataFrame, sites: DataFrame, radius_m: float, keys=("aoi_id",)) -> DataFrame:
    """Per demand point: how many sites cover it (copies at one spot are counted, not paired)."""
    spots = sites.groupBy(*keys, "lon", "lat").agg(F.count(F.lit(1)).alias("copies"))
    places = demand.select(*keys, "lon", "lat").distinct()
    hits = pairs_within(places, spots, radius_m, keys).groupBy(*keys, "lon", "lat").agg(
        F.sum("copies").alias("n_sites")
    )
    return demand.join(hits, [*keys, "lon", "lat"], "left").withColumn(
        "n_sites", F.coalesce("n_sites", F.lit(0).cast("bigint"))
    )
