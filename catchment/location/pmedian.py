"""p-median: fewest weighted metres to the nearest of p open sites.

The cost of a candidate is a sum over all demand, so a plain round would meet
every (site, demand) pair.  Here demand is first summed into cells.  Distances
are convex, so a cell's true cost lies between that at its weighted centre and
a little more, which bounds every candidate from both sides.  Only
candidates whose lower bound reaches the best upper bound stay; cells get finer
while many stay, and the few that remain are costed exactly over all demand.
The result equals the exhaustive round.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from ..functions import geo
from ..operators.nearest import nearest_site
from .common import COST_DIGITS, best_site, demand_spots, spread, table

FIRST_SIDE = 16
LAST_SIDE = 4096
# candidates per key that may be costed exactly without another screening pass
FEW = 64
# (site, spot) pairs of all keys that are costed outright: less work than a screening pass
EXACT_PAIRS = 50_000_000
# cells (all keys together) that may be sent to every executor: about 60 MB
BROADCAST_CELLS = 1_000_000
def rounded(c):
    return F.round(c, COST_DIGITS)


# stands for "no site open yet"; larger than half the equator
FAR_M = 3.0e7
# bounds may be off by rounding to millimetres
_SLACK_M = 0.002
# how much faster than a chord of the sphere its arc may grow, for chords up to the radius
_BEND = 1.16


def _screen_cells(spots: DataFrame, box: DataFrame, keys, side: int, metric) -> DataFrame:
    """Cells of a side x side grid per key: weight, centre, and error weight."""
    def idx(v, lo, hi):
        span = F.col(hi) - F.col(lo)
        return F.when(span > 0, F.least(F.lit(side - 1), F.floor((F.col(v) - F.col(lo)) / span * side))).otherwise(F.lit(0))

    d = spots.join(box, list(keys))
    d = d.withColumn("_ix", idx("lon", "bx0", "bx1")).withColumn("_iy", idx("lat", "by0", "by1"))
    d = d.withColumn("_cx", F.col("bx0") + (F.col("_ix") + 0.5) * (F.col("bx1") - F.col("bx0")) / side).withColumn(
        "_cy", F.col("by0") + (F.col("_iy") + 0.5) * (F.col("by1") - F.col("by0")) / side
    )
    off = metric.dist(F.col("lon"), F.col("lat"), F.col("_cx"), F.col("_cy")) + 0.002
    return d.groupBy(*keys, "_ix", "_iy").agg(
        F.sum("weight").alias("cw"), F.sum(F.col("weight") * off).alias("ce"),
        F.first("_cx").alias("cx"), F.first("_cy").alias("cy"),
    ).withColumn("cid", (F.col("_ix") * side + F.col("_iy")).cast("bigint")).drop("_ix", "_iy")


def _bound_cells(spots: DataFrame, box: DataFrame, keys, side: int, metric) -> tuple[DataFrame, DataFrame]:
    """Cells of a side x side grid per key, around their weighted centres in the metric's own space.

    The first table stays as it is whatever opens: cw is the weight, off the farthest point
    from the centre, ce and cv sums of weight x distance to the centre and of its square.
    The second follows d1: s1 is the sum of weight x d1, lo and hi are the ends of d1.
    """
    k = list(keys)
    at = metric.embed(F.col("lon"), F.col("lat"))
    axes = [f"_a{i}" for i in range(len(at))]
    # a point without a place costs the same whatever opens
    d = spots.where("lon is not null and lat is not null and weight is not null").join(F.broadcast(box), k)

    def idx(v, lo, hi):
        span = F.col(hi) - F.col(lo)
        return F.when(span > 0, F.least(F.lit(side - 1), F.floor((F.col(v) - F.col(lo)) / span * side))).otherwise(F.lit(0))

    d = d.select(*k, "weight", "d1", idx("lon", "bx0", "bx1").alias("_ix"), idx("lat", "by0", "by1").alias("_iy"), *[c.alias(a) for a, c in zip(axes, at)])
    w = F.col("weight")
    mid = d.groupBy(*k, "_ix", "_iy").agg(
        F.sum("weight").alias("cw"), *[F.coalesce(F.sum(w * F.col(a)) / F.sum(w), F.avg(a)).alias(f"c{i}") for i, a in enumerate(axes)]
    )
    mids = [f"c{i}" for i in range(len(axes))]
    off = F.sqrt(sum(((F.col(a) - F.col(c)) * (F.col(a) - F.col(c)) for a, c in zip(axes, mids)), F.lit(0.0)))
    shape = d.join(mid, [*k, "_ix", "_iy"]).withColumn("_off", off).groupBy(*k, "_ix", "_iy").agg(
        F.sum("weight").alias("cw"), F.max("_off").alias("off"), F.sum(w * F.col("_off")).alias("ce"),
        F.sum(w * F.col("_off") * F.col("_off")).alias("cv"), *[F.first(c).alias(c) for c in mids],
    )
    served = d.groupBy(*k, "_ix", "_iy").agg(F.sum(w * F.col("d1")).alias("s1"), F.min("d1").alias("lo"), F.max("d1").alias("hi"))
    return shape, served


class GreedyState:
    """Demand spots with the distance d1 to the nearest open site."""

    def __init__(self, demand: DataFrame, candidates: DataFrame, keys: Sequence[str], metric=geo.Haversine, opened: DataFrame | None = None):
        self.keys = list(keys)
        self.metric = metric
        spots = demand_spots(demand, keys).select(*self.keys, "demand_id", "lon", "lat", "weight")
        spots = spots.withColumn("d1", F.lit(FAR_M))
        if opened is not None:
            spots = self._served(spots, opened)
        self.spots = self._stored(spots)
        self._given = candidates.select(*self.keys, "site_id", "lon", "lat")
        self.box = table(self.spots.groupBy(*self.keys).agg(
            F.min("lon").alias("bx0"), F.max("lon").alias("bx1"), F.min("lat").alias("by0"), F.max("lat").alias("by1"),
            F.count(F.lit(1)).alias("_spots"),
        ), "box")
        self.open: DataFrame | None = opened
        # cells by side, kept from round to round: only d1 changes
        self._shapes: dict[int, DataFrame] = {}

    @cached_property
    def sites(self) -> DataFrame:
        """All candidates, stored for the rounds that choose from them."""
        return table(self._given, "sites")

    def _cells(self, side: int) -> DataFrame:
        shape, served = _bound_cells(self.spots, self.box, self.keys, side, self.metric)
        if side not in self._shapes:
            self._shapes[side] = table(shape, "cells")
        return self._shapes[side].join(served, [*self.keys, "_ix", "_iy"]).drop("_ix", "_iy")

    def _stored(self, spots: DataFrame) -> DataFrame:
        return table(spread(spots, *self.keys, "lon", "lat"), "spots")

    def _served(self, spots: DataFrame, opened: DataFrame) -> DataFrame:
        k = self.keys
        o = opened.select(*k, F.col("lon").alias("_sx"), F.col("lat").alias("_sy"))
        d = self.metric.dist(F.col("lon"), F.col("lat"), F.col("_sx"), F.col("_sy"))
        near = spots.join(o, k, "left").groupBy(*k, "demand_id", "lon", "lat", "weight", "d1").agg(F.min(d).alias("_d"))
        return near.select(*k, "demand_id", "lon", "lat", "weight", F.least("d1", F.coalesce("_d", F.col("d1"))).alias("d1"))

    def _ends(self) -> tuple:
        """Columns: the least and the most that a cell's demand may cost once a site at ``_d`` from its centre is open.

        A distance is convex in the point, so a cell costs at least its weight times the distance
        of its weighted centre, and at most that and half its second moment over the distance;
        0.8 instead of a half covers the bend of the sphere up to its radius.  Where the site
        serves nobody in the cell the cost stays as it is; where it may serve some, both
        ends follow from those of d1.
        """
        d = F.col("_d")
        w, s1, slack = F.col("cw"), F.col("s1"), F.lit(_SLACK_M)
        off = F.col("off") * _BEND + slack
        first = F.col("ce") * _BEND + w * slack
        most = first if self.metric is geo.Manhattan else F.least(first, F.when(d > 0.01, F.col("cv") * 0.8 / (d - slack)).otherwise(first) + w * slack)
        far = (d + off > geo.EARTH_RADIUS_M) if self.metric is geo.Haversine else F.lit(False)
        idle, wins = d - off >= F.col("hi"), d + off <= F.col("lo")
        part = F.greatest(w * F.least(F.col("lo"), F.greatest(F.lit(0.0), d - off)), s1 - w * F.greatest(F.lit(0.0), F.col("hi") - d + off))
        low = F.when(d >= 2 * FAR_M, s1).when(far, F.lit(0.0)).when(idle, s1).when(wins, w * (d - slack)).otherwise(part)
        high = F.when(far | idle, s1).otherwise(F.least(s1, w * d + most))
        return low, high

    def _estimates(self, cand: DataFrame, cells: DataFrame) -> DataFrame:
        """(keys, site_id, lon, lat, low, high): the ends of the cost of each candidate, from cells."""
        k = self.keys
        at = self.metric.embed(F.col("lon"), F.col("lat"))
        placed = cand.withColumns({f"_s{i}": c for i, c in enumerate(at)})
        d = self.metric.between([F.col(f"_s{i}") for i in range(len(at))], [F.col(f"c{i}") for i in range(len(at))])
        low, high = self._ends()
        # a column of its own, so that a pair's distance is computed once; a site without a place serves nobody
        near = placed.join(cells, k).withColumn("_d", F.coalesce(d, F.lit(2 * FAR_M)))
        return near.groupBy(*k, "site_id", "lon", "lat").agg(F.sum(low).alias("low"), F.sum(high).alias("high"))

    def survivors(self, cand: DataFrame) -> DataFrame:
        """Candidates that may still be the best of this round.

        A first count decides whether screening pays; each pass costs candidates
        x cells, and finer cells leave fewer survivors.
        """
        k = self.keys
        side = FIRST_SIDE
        while side <= LAST_SIDE:
            per_key = cand.groupBy(*k).count().join(F.broadcast(self.box), k)
            n, n_keys, work = per_key.agg(F.max("count"), F.count(F.lit(1)), F.sum(F.col("count") * F.col("_spots"))).first()
            if (n or 0) <= FEW or work <= EXACT_PAIRS:
                return cand
            cells = self._cells(side)
            if n_keys * side * side <= BROADCAST_CELLS:
                cells = F.broadcast(cells)
            est = self._estimates(spread(cand.select(*k, "site_id", "lon", "lat"), *k, "site_id"), cells)
            est = table(est, "ends")
            top = est.groupBy(*k).agg(F.min("high").alias("_ub"))
            # sums of doubles differ in their last bits
            left = est.join(top, k).where(F.col("low") <= F.col("_ub") + F.abs("_ub") * 1e-12 + 1.0)
            cand = table(left.select(*k, "site_id", "lon", "lat"), "screen")
            side *= 4
        return cand

    def costs(self, cand: DataFrame) -> DataFrame:
        """Exact cost of opening each candidate next to what is open."""
        k = self.keys
        c = cand.select(*k, "site_id", F.col("lon").alias("_sx"), F.col("lat").alias("_sy"))
        d = self.metric.dist(F.col("lon"), F.col("lat"), F.col("_sx"), F.col("_sy"))
        return self.spots.join(c, k).groupBy(*k, "site_id", "_sx", "_sy").agg(
            rounded(F.sum(F.col("weight") * F.least("d1", d))).alias("cost")
        ).withColumnsRenamed({"_sx": "lon", "_sy": "lat"})

    def best(self, cand: DataFrame) -> DataFrame:
        """(keys, site_id, cost, lon, lat) of the cheapest candidate per key."""
        costs = self.costs(self.survivors(cand)).withColumn("neg", -F.col("cost"))
        pick = best_site(costs, self.keys, "neg", extra=["lon", "lat"])
        return table(pick.withColumn("cost", -F.col("neg")).drop("neg"), "pick")

    def add_many(self, given: DataFrame) -> None:
        """Open a set of any size."""
        k = self.keys
        near = nearest_site(self.spots, given, k, metric=self.metric, dist_name="_d", id_name="_o")
        self.spots = self._stored(near.select(*k, "demand_id", "lon", "lat", "weight", F.least("d1", F.coalesce("_d", F.col("d1"))).alias("d1")))
        self.open = given if self.open is None else self.open.unionByName(given)

    def add(self, picked: DataFrame) -> None:
        """Open the picked sites (keys, site_id, lon, lat), a handful per key, and update d1."""
        k = self.keys
        got = picked.select(*k, "site_id", "lon", "lat")
        self.spots = self._stored(self._served(self.spots, got))
        self.open = got if self.open is None else self.open.unionByName(got)

    def remaining(self, exclude: DataFrame | None = None) -> DataFrame:
        left = self.sites
        if self.open is not None:
            left = left.join(self.open.select(*self.keys, "site_id"), [*self.keys, "site_id"], "left_anti")
        if exclude is not None:
            left = left.join(exclude.select(*self.keys, "site_id"), [*self.keys, "site_id"], "left_anti")
        return left


def p_median_greedy(
    demand: DataFrame,
    candidates: DataFrame,
    p: int,
    keys: Sequence[str] = ("aoi_id",),
    must_open: DataFrame | None = None,
    must_close: DataFrame | None = None,
    metric=geo.Haversine,
) -> DataFrame:
    """(keys, step, site_id, cost): cost is the objective after that step.

    Forced sites come first with step 0 and count toward p; keys with fewer than
    p sites open all they have.
    """
    k = list(keys)
    st = GreedyState(demand, candidates, k, metric)
    steps: list[DataFrame] = []
    quota = None
    if must_open is not None:
        given = must_open.select(*k, "site_id").join(st.sites, [*k, "site_id"])
        st.add_many(table(given, "given"))
        base = st.spots.groupBy(*k).agg(rounded(F.sum(F.col("weight") * F.col("d1"))).alias("cost"))
        steps.append(st.open.join(base, k).select(*k, F.lit(0).alias("step"), "site_id", "cost"))
        quota = st.open.groupBy(*k).agg((F.lit(p) - F.count(F.lit(1))).alias("_quota"))
        quota = table(quota, "quota")
    for step in range(1, p + 1):
        cand = st.remaining(must_close)
        if quota is not None:
            cand = cand.join(quota, k, "left").where(F.coalesce("_quota", F.lit(p)) >= step).drop("_quota")
        pick = st.best(cand)
        if pick.isEmpty():
            break
        steps.append(pick.select(*k, F.lit(step).alias("step"), "site_id", "cost"))
        if step < p:
            st.add(pick)
    if not steps:
        none = [F.lit(None).cast(t).alias(c) for c, t in (("step", "int"), ("site_id", "bigint"), ("cost", "double"))]
        return demand.select(*k, *none).limit(0)
    out = steps[0]
    for s in steps[1:]:
        out = out.unionByName(s)
    return out


def objective(demand: DataFrame, selected: DataFrame, keys: Sequence[str] = ("aoi_id",), metric=geo.Haversine) -> DataFrame:
    """Total weighted distance to the nearest of the selected sites."""
    n = nearest_site(demand, selected, keys, metric=metric)
    return n.groupBy(*keys).agg(rounded(F.sum(F.col("weight") * F.col("dist_m"))).alias("cost"))


def p_median_swap(
    demand: DataFrame,
    candidates: DataFrame,
    selected: DataFrame,
    keys: Sequence[str] = ("aoi_id",),
    max_swaps: int | None = None,
    metric=geo.Haversine,
) -> DataFrame:
    """(keys, site_id, cost, rounds, converged) after exchanging sites while that lowers the cost.

    Closing r and opening the best site then is one greedy round over the open
    set without r; all r of all keys are tried in one keyed round.
    """
    k = list(keys)
    xy = candidates.select(*k, "site_id", "lon", "lat")
    cur = table(selected.select(*k, "site_id").join(xy, [*k, "site_id"]), "open")
    cost = table(objective(demand, cur, k, metric), "cost")
    swaps, converged = 0, False
    while max_swaps is None or swaps < max_swaps:  # the cost falls with every swap, so it ends
        gone = cur.select(*k, F.col("site_id").alias("gone"))
        rest = gone.join(cur, k).where(F.col("gone") != F.col("site_id"))
        kk = [*k, "gone"]
        d = demand.select(*k, "demand_id", "lon", "lat", "weight").join(gone, k)
        pool = gone.join(xy, k).join(cur.select(*k, "site_id"), [*k, "site_id"], "left_anti")
        st = GreedyState(d, pool, kk, metric, opened=rest)
        best = st.best(pool).groupBy(*k).agg(F.min(F.struct("cost", "gone", "site_id")).alias("m"))
        better = best.select(*k, F.col("m.cost").alias("new_cost"), "m.gone", "m.site_id")
        better = table(better.join(cost, k).where(F.col("new_cost") < F.col("cost")), "swap")
        if better.isEmpty():
            converged = True
            break
        swaps += 1
        kept = cur.join(better.select(*k, F.col("gone").alias("site_id")), [*k, "site_id"], "left_anti")
        cur = table(kept.unionByName(better.select(*k, "site_id").join(xy, [*k, "site_id"])), "open")
        upd = better.select(*k, "new_cost")
        cost = table(cost.join(upd, k, "left").select(*k, F.coalesce("new_cost", "cost").alias("cost")), "cost")
    return cur.select(*k, "site_id").join(cost, k).withColumns({"rounds": F.lit(swaps), "converged": F.lit(converged)})


def p_median_bound(
    demand: DataFrame,
    candidates: DataFrame,
    p: int,
    upper: DataFrame,
    keys: Sequence[str] = ("aoi_id",),
    side: int = 16,
    rounds: int = 6,
    metric=geo.Haversine,
) -> DataFrame:
    """(keys, lower_bound) for the p-median cost by Lagrangian relaxation over cells.

    Pricing a point at its cell's price minus its distance to the centre makes
    the cell-level relaxation minus the total of weight x distance-to-centre a
    valid bound for the point-level problem, for any prices.  ``upper`` holds
    (keys, cost) of a known solution and only sets the step length.
    """
    from ..operators.measures import top_n

    k = list(keys)
    spots = table(demand_spots(demand, k), "spots")
    box = spots.groupBy(*k).agg(
        F.min("lon").alias("bx0"), F.max("lon").alias("bx1"), F.min("lat").alias("by0"), F.max("lat").alias("by1")
    )
    cells = _screen_cells(spots, box, k, side, metric)
    ub = upper.select(*k, F.col("cost").alias("ub"))
    tot = spots.groupBy(*k).agg(F.sum("weight").alias("tw"))
    start = cells.join(ub, k).join(tot, k).withColumn("price", F.col("ub") / F.col("tw"))
    cells = table(start.select(*k, "cx", "cy", "cw", "ce", "ub", "price"), "prices")
    xy = candidates.select(*k, "site_id", "lon", "lat")
    best: DataFrame | None = None
    scale = 1.0
    for _ in range(rounds):
        d = metric.dist(F.col("lon"), F.col("lat"), F.col("cx"), F.col("cy")) - 0.002
        save = F.sum(F.col("cw") * F.least(F.lit(0.0), d - F.col("price")))
        rho = xy.join(cells, k).groupBy(*k, "site_id", "lon", "lat").agg(save.alias("rho"))
        cheap = table(top_n(rho, k, [F.asc("rho"), F.asc("site_id")], p), "rho")
        part = cheap.groupBy(*k).agg(F.sum("rho").alias("r"))
        value = cells.groupBy(*k).agg(F.sum(F.col("cw") * F.col("price") - F.col("ce")).alias("v"), F.sum(F.col("cw") * F.col("price")).alias("lag"), F.max("ub").alias("ub"))
        now = table(value.join(part, k).select(*k, (F.col("v") + F.col("r")).alias("lb"), (F.col("lag") + F.col("r")).alias("lag"), "ub"), "bound")
        best = now.select(*k, "lb") if best is None else best.unionByName(now.select(*k, "lb"))
        used = cells.join(cheap.select(*k, F.col("lon").alias("_sx"), F.col("lat").alias("_sy")), k)
        dd = metric.dist(F.col("_sx"), F.col("_sy"), F.col("cx"), F.col("cy"))
        hits = used.groupBy(*k, "cx", "cy").agg(F.count(F.when(dd < F.col("price"), 1)).alias("hits"))
        g = cells.join(hits, [*k, "cx", "cy"]).withColumn("g", (1 - F.col("hits")).cast("double"))
        norm = g.groupBy(*k).agg(F.sum(F.col("cw") * F.col("g") * F.col("g")).alias("nn"))
        step = F.when(F.col("nn") > 0, F.greatest(F.lit(0.0), F.col("u") - F.col("lag")) / F.col("nn")).otherwise(F.lit(0.0))
        moved = g.join(norm, k).join(now.select(*k, "lag", F.col("ub").alias("u")), k)
        cells = table(
            moved.select(*k, "cx", "cy", "cw", "ce", "ub", F.greatest(F.lit(0.0), F.col("price") + F.lit(scale) * step * F.col("g")).alias("price")), "prices"
        )
        scale *= 0.7
    return best.groupBy(*k).agg(F.greatest(F.lit(0.0), F.max("lb")).alias("lower_bound"))


def assign_with_capacity(
    demand: DataFrame,
    opened: DataFrame,
    keys: Sequence[str] = ("aoi_id",),
    metric=geo.Haversine,
) -> DataFrame:
    """Single-source assignment to open sites (with ``capacity``) of all demand rows.

    Each round every open demand asks its nearest site that has not refused it;
    a site takes the closest askers while they fit and refuses the rest.
    Unassigned rows (no room anywhere) come back with a null site.
    """
    from ..operators.running import running_totals

    k = list(keys)
    o = opened.select(*k, "site_id", "capacity", F.col("lon").alias("_sx"), F.col("lat").alias("_sy"))
    d = demand.select(*k, "demand_id", "lon", "lat", "weight")
    dist = metric.dist(F.col("lon"), F.col("lat"), F.col("_sx"), F.col("_sy"))
    options = table(d.join(o, k).select(*k, "demand_id", "weight", "site_id", "capacity", dist.alias("dist_m")), "options")
    taken: DataFrame | None = None
    while True:  # a round assigns or refuses, so it ends
        ask = options.groupBy(*k, "demand_id").agg(F.min(F.struct("dist_m", "site_id", "weight", "capacity")).alias("m"))
        ask = ask.select(*k, "demand_id", "m.dist_m", "m.site_id", "m.weight", "m.capacity")
        if taken is not None:
            used = taken.groupBy(*k, "site_id").agg(F.sum("weight").alias("_used"))
            ask = ask.join(used, [*k, "site_id"], "left")
            room = F.col("capacity") - F.coalesce("_used", F.lit(0.0))
        else:
            room = F.col("capacity")
        ask = ask.withColumn("_room", room).drop("_used")
        run = running_totals(ask, [*k, "site_id"], "dist_m", ["weight"], tie=["demand_id"])
        run = table(run.withColumn("fits", F.round(F.col("cum_weight"), 6) <= F.round("_room", 6)), "asked")
        if run.isEmpty():
            break
        got = run.where("fits").select(*k, "demand_id", "site_id", "weight", "dist_m")
        taken = table(got if taken is None else taken.unionByName(got), "taken")
        left = options.join(got.select(*k, "demand_id"), [*k, "demand_id"], "left_anti")
        refused = run.where("not fits").select(*k, "demand_id", "site_id")
        options = table(left.join(refused, [*k, "demand_id", "site_id"], "left_anti"), "options")
    if taken is None:  # there was nothing to choose from
        taken = options
    out = taken.select(*k, "demand_id", "site_id", "dist_m")
    return demand.select(*k, "demand_id", "weight").join(out, [*k, "demand_id"], "left")


def _with_fillers(pool: DataFrame, k: list[str], value: str, places: int, order) -> DataFrame:
    """``pool`` with ``_rest``: the sum of ``value`` over the first ``places`` - 1 other sites of the key."""
    from ..operators.measures import top_n

    fill = top_n(pool, k, [order(value), F.asc("site_id")], places, rank="_r").select(*k, F.col("site_id").alias("_fs"), F.col(value).alias("_fv"), "_r")
    need = pool.join(fill, k, "left").groupBy(*k, "site_id", "lon", "lat", value).agg(
        F.sum(F.when((F.col("_fs") != F.col("site_id")), F.col("_fv"))).alias("_all"),
        F.max(F.when(F.col("_fs") == F.col("site_id"), 1)).alias("_in"),
        F.max(F.when(F.col("_r") == places, F.col("_fv"))).alias("_last"),
    )
    rest = F.coalesce("_all", F.lit(0.0)) - F.when(F.col("_in").isNull(), F.coalesce("_last", F.lit(0.0))).otherwise(F.lit(0.0))
    return need.withColumn("_rest", rest)


def p_median_capacitated(
    demand: DataFrame, candidates: DataFrame, p: int, keys: Sequence[str] = ("aoi_id",), metric=geo.Haversine
) -> tuple[DataFrame, DataFrame]:
    """p-median whose sites (with ``capacity``) can hold all demand, and its assignment.

    A site is only opened while it and the largest sites for the places left still hold
    the key's demand, so a near site too small to leave a feasible rest is passed over.
    Returns ((keys, step, site_id, capacity), (keys, demand_id, weight, site_id, dist_m, status)).
    Status is 'assigned'; 'no room' for a row that fits no opened site whole; 'over capacity'
    for all rows of a key whose p largest sites cannot hold them.
    """
    k = list(keys)
    st = GreedyState(demand, candidates, k, metric)
    cap = candidates.select(*k, "site_id", F.col("capacity").cast("double").alias("capacity"))
    held = table(demand.groupBy(*k).agg(F.sum("weight").alias("total"), F.lit(0.0).alias("held")), "held")
    steps = None
    for step in range(1, p + 1):
        pool = st.remaining().join(cap, [*k, "site_id"])
        ok = _with_fillers(pool, k, "capacity", p - step + 1, F.desc).join(held, k)
        ok = ok.where(F.round(F.col("held") + F.col("capacity") + F.col("_rest"), 6) >= F.round("total", 6))
        pick = st.best(table(ok.select(*k, "site_id", "lon", "lat"), "roomy")).join(cap, [*k, "site_id"])
        pick = table(pick.select(*k, F.lit(step).alias("step"), "site_id", "cost", "capacity", "lon", "lat"), "pick")
        if pick.isEmpty():
            break
        steps = pick if steps is None else steps.unionByName(pick)
        held = table(held.join(pick.select(*k, F.col("capacity").alias("_c")), k, "left").select(*k, "total", (F.col("held") + F.coalesce("_c", F.lit(0.0))).alias("held")), "held")
        if step < p:
            st.add(pick)
    if steps is None:
        steps = candidates.select(*k, F.lit(0).alias("step"), "site_id", F.col("capacity").cast("double").alias("capacity"), "lon", "lat").limit(0)
    fits = steps.select(*k).distinct().withColumn("_fits", F.lit(True))
    a = assign_with_capacity(demand.join(fits, k, "left_semi"), steps, k, metric)
    out = demand.select(*k, "demand_id", "weight").join(a.drop("weight"), [*k, "demand_id"], "left").join(fits, k, "left")
    status = F.when(F.col("_fits").isNull(), "over capacity").when(F.col("site_id").isNull(), "no room").otherwise("assigned")
    return steps.select(*k, "step", "site_id", "capacity"), out.withColumn("status", status).drop("_fits")


def p_median_budget(
    demand: DataFrame, candidates: DataFrame, p: int, budget: float, keys: Sequence[str] = ("aoi_id",), metric=geo.Haversine
) -> DataFrame:
    """Greedy p-median that keeps total cost within the budget.

    A site is only considered while the cheapest way to fill the remaining
    places still fits the budget, so p sites are reached whenever they can be.
    (keys, step, site_id, cost, spent)
    """
    k = list(keys)
    st = GreedyState(demand, candidates, k, metric)
    price = candidates.select(*k, "site_id", F.col("cost").alias("price"))
    spent = table(price.groupBy(*k).agg(F.lit(0.0).alias("spent"), F.count(F.lit(1)).alias("_n")), "spent")
    steps = None
    for step in range(1, p + 1):
        pool = st.remaining().join(price, [*k, "site_id"])
        # the cheapest fillers for the places still open after this one
        ok = _with_fillers(pool, k, "price", p - step + 1, F.asc).join(spent, k).where(F.col("spent") + F.col("price") + F.col("_rest") <= budget)
        ok = table(ok.select(*k, "site_id", "lon", "lat"), "affordable")
        pick = st.best(ok).join(price, [*k, "site_id"]).join(spent, k)
        pick = table(pick.select(*k, F.lit(step).alias("step"), "site_id", "cost", (F.col("spent") + F.col("price")).alias("spent"), "lon", "lat"), "pick")
        if pick.isEmpty():
            break
        row = pick.drop("lon", "lat")
        steps = row if steps is None else steps.unionByName(row)
        upd = pick.select(*k, F.col("spent").alias("_s"))
        spent = table(spent.join(upd, k, "left").select(*k, F.coalesce("_s", "spent").alias("spent"), "_n"), "spent")
        if step < p:
            st.add(pick)
    if steps is None:  # nothing is affordable
        none = [F.lit(None).cast(t).alias(c) for c, t in (("step", "int"), ("site_id", "bigint"), ("cost", "double"), ("spent", "double"))]
        return demand.select(*k, *none).limit(0)
    return steps


def p_median_max_distance(
    demand: DataFrame, candidates: DataFrame, p: int, limit_m: float, keys: Sequence[str] = ("aoi_id",), metric=geo.Haversine
) -> DataFrame:
    """p-median where nobody may travel further than ``limit_m``.

    A greedy cover within the limit is opened first, the places left go to the
    p-median greedy.  Keys whose coverable demand needs more than p sites by
    greedy, or with demand out of any site's reach, say so in ``status``.
    (keys, step, site_id, cost, status)
    """
    from . import cover

    k = list(keys)
    pairs = cover.cover_reach(demand, candidates, limit_m, k, value=F.lit(1.0))
    must = cover.drop_redundant(pairs, cover.greedy_cover(pairs, k), k)
    near = nearest_site(pairs.spots.select(*k, "demand_id", "lon", "lat"), candidates.select(*k, "site_id", "lon", "lat"), k, max_m=limit_m)
    reach = near.where("dist_m is not null").select(*k, "demand_id").distinct().groupBy(*k).agg(F.count(F.lit(1)).alias("_in"))
    spots = demand_spots(demand, k).groupBy(*k).agg(F.count(F.lit(1)).alias("_all"))
    need = must.groupBy(*k).agg(F.count(F.lit(1)).alias("_need"))
    judged = spots.join(reach, k, "left").join(need, k, "left").select(
        *k,
        F.when(F.coalesce("_in", F.lit(0)) < F.col("_all"), "infeasible")
        .when(F.col("_need") > p, "not found")
        .otherwise("feasible").alias("status"),
    )
    judged = table(judged, "status")
    ok = judged.where("status = 'feasible'").select(*k)
    steps = p_median_greedy(
        demand.join(ok, k, "left_semi"), candidates.join(ok, k, "left_semi"), p, k, must_open=must.join(ok, k, "left_semi"), metric=metric
    )
    return judged.join(steps, k, "left").select(*k, "step", "site_id", "cost", "status")
