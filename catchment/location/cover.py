"""Covering models: MCLP (cover most with p sites) and LSCP (cover all with fewest).

All variants share one relation: (keys, demand_id, site_id, value, coef, need).
A demand still needs ``need``; an open site in reach gives ``coef``; its gain is
``value x min(need, coef)``.  Classical cover is need 1, coef 1; backup is need
k; reliability enters through coef (as is, or as -ln(1-r) in log space).

Where distance alone decides, ``cover_reach`` gives a ``Reach`` that stands for the
relation without writing it; every function here takes either.
"""

from __future__ import annotations

import math
from itertools import count
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..operators.coverage import beside, pairs_within, peaks, rim_cells, rows_in_reach
from ..session import release
from .common import GAIN_DIGITS, best_site, coverage, demand_spots, sorted_in, table
from .reach import EPS, Reach, ReachGains

#: Pairs that still matter are written once there are no more of them than this.
PAIRS_AT_ONCE = 5_000_000

Relation = DataFrame | Reach


def cover_pairs(
    demand: DataFrame,
    sites: DataFrame,
    radius_m: float,
    keys: Sequence[str],
    need: float = 1.0,
    coef=None,
    value=None,
) -> DataFrame:
    """The shared relation, written once per run; copies on a spot are one row."""
    k = list(keys)
    cov = coverage(demand_spots(demand, k), sites, radius_m, k)
    c = F.lit(1.0) if coef is None else coef
    v = F.col("weight") if value is None else value
    return table(
        cov.select(*k, "demand_id", "site_id", v.alias("value"), c.alias("coef"), F.lit(float(need)).alias("need")), "pairs"
    )


def cover_reach(
    demand: DataFrame,
    sites: DataFrame,
    radius_m: float,
    keys: Sequence[str],
    need: float = 1.0,
    coef=None,
    value=None,
) -> Reach:
    """``cover_pairs`` without the pairs: ``value`` is of the demand's columns, ``coef`` of the sites'."""
    k = list(keys)
    v, c = F.col("weight") if value is None else value, F.lit(1.0) if coef is None else coef
    spots = demand_spots(demand, k).select(*k, "demand_id", "lon", "lat", v.alias("value"), F.lit(float(need)).alias("need"))
    at = sites.select(*k, "site_id", "lon", "lat", c.cast("double").alias("coef"), F.lit(float(radius_m)).alias("reach"))
    return Reach(table(spots, "spots"), table(at, "sites"), radius_m, k)


def _gains(pairs: Relation, keys: Sequence[str], gain=None) -> Gains | ReachGains:
    return ReachGains(pairs, gain or classic_gain) if isinstance(pairs, Reach) else Gains(pairs, keys, gain)


def _of_sites(pairs: Relation, sites: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The pairs of the given sites."""
    k = list(keys)
    return pairs.only(sites).pairs() if isinstance(pairs, Reach) else pairs.join(sites.select(*k, "site_id"), [*k, "site_id"])


def _without(pairs: Relation, sites: DataFrame, keys: Sequence[str]) -> Relation:
    k = list(keys)
    return pairs.without(sites) if isinstance(pairs, Reach) else pairs.join(sites.select(*k, "site_id"), [*k, "site_id"], "left_anti")


def _none(pairs: Relation, k: Sequence[str], **cols: str) -> DataFrame:
    """No rows, with the keys and the given typed columns."""
    pairs = pairs.sites if isinstance(pairs, Reach) else pairs
    return pairs.select(*k, *[F.lit(None).cast(t).alias(c) for c, t in cols.items()]).limit(0)


def _gain():
    return F.col("value") * F.least("need", "coef")


def _score():
    return F.round(F.sum(_gain()), GAIN_DIGITS)


def open_sites(pairs: DataFrame, picks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pairs that still matter after opening ``picks``."""
    k = list(keys)
    chosen = picks.select(*k, "site_id")
    given = pairs.join(chosen, [*k, "site_id"]).groupBy(*k, "demand_id").agg(F.sum("coef").alias("_given"))
    rest = pairs.join(chosen, [*k, "site_id"], "left_anti").join(sorted_in(given), [*k, "demand_id"], "left")
    rest = rest.withColumn("need", F.col("need") - F.coalesce("_given", F.lit(0.0))).drop("_given")
    return table(rest.where(F.col("need") > EPS), "pairs")


def pairs_of_relation(pairs: DataFrame, keys: Sequence[str], need: float = 1.0, coef=None, value=None) -> DataFrame:
    """The shared relation from given covered pairs (keys, demand_id, site_id, weight), such as road distances within a radius."""
    k = list(keys)
    c, v = F.lit(1.0) if coef is None else coef, F.col("weight") if value is None else value
    return table(pairs.select(*k, "demand_id", "site_id", v.alias("value"), c.alias("coef"), F.lit(float(need)).alias("need")), "pairs")


class Gains:
    """What every closed site would gain, corrected by differences as sites open.

    The pairs stay as they were written.  Opening sites lowers the need of the demand they
    reach; only pairs of that demand are read again, and only the change of their gain is
    added to the table of gains.
    """

    def __init__(self, pairs: DataFrame, keys: Sequence[str], gain=None):
        self.keys, self.pairs = list(keys), pairs
        self.gain = gain or classic_gain
        self.needs = table(pairs.groupBy(*self.keys, "demand_id").agg(F.max("need").alias("need")), "needs")
        self.table = table(pairs.groupBy(*self.keys, "site_id").agg(F.sum(self._of("need")).alias("gain")), "gains")

    def _of(self, need: str):
        n = F.col(need)
        return F.when(n > EPS, self.gain(F.col("value"), n, F.col("coef"))).otherwise(F.lit(0.0))

    def scores(self) -> DataFrame:
        """(keys, site_id, gain) of sites that gain anything."""
        scores = self.table.select(*self.keys, "site_id", F.round("gain", GAIN_DIGITS).alias("score")).where("score > 0")
        return scores.withColumnRenamed("score", "gain")

    def open(self, picks: DataFrame) -> None:
        k = self.keys
        picks = picks.select(*k, "site_id").distinct()
        given = self.pairs.join(picks, [*k, "site_id"], "left_semi").groupBy(*k, "demand_id").agg(F.sum("coef").alias("_given"))
        hit = table(given.join(sorted_in(self.needs.where(F.col("need") > EPS)), [*k, "demand_id"]).withColumn("_left", F.col("need") - F.col("_given")).drop("_given"), "hit")
        change = self.pairs.drop("need").join(sorted_in(hit), [*k, "demand_id"]).groupBy(*k, "site_id").agg(F.sum(self._of("_left") - self._of("need")).alias("_d"))
        gains = self.table.join(picks, [*k, "site_id"], "left_anti").join(change, [*k, "site_id"], "left")
        needs = self.needs.join(sorted_in(hit.select(*k, "demand_id", "_left")), [*k, "demand_id"], "left")
        old = self.table, self.needs
        self.table = table(gains.select(*k, "site_id", (F.col("gain") + F.coalesce("_d", F.lit(0.0))).alias("gain")), "gains")
        self.needs = table(needs.select(*k, "demand_id", F.coalesce("_left", "need").alias("need")), "needs")
        release(hit, *old)


def classic_gain(value, need, coef):
    return value * F.least(need, coef)


def multi_gain(k: float):
    """Full value on the last missing cover, a k-th of it before that."""
    return lambda value, need, coef: F.when(need <= 1 + EPS, value).otherwise(value / k)


def greedy_p(
    pairs: Relation,
    p: int,
    keys: Sequence[str] = ("aoi_id",),
    must_open: DataFrame | None = None,
    must_close: DataFrame | None = None,
    gain=None,
) -> DataFrame:
    """p rounds of the best gain per key: (keys, step, site_id, gain)."""
    k = list(keys)
    if must_close is not None:
        pairs = _without(pairs, must_close, k)
    st = _gains(pairs, k, gain)
    steps = quota = None
    if must_open is not None:
        steps = must_open.select(*k, F.lit(0).alias("step"), "site_id").join(st.scores(), [*k, "site_id"], "left").select(
            *k, "step", "site_id", F.coalesce("gain", F.lit(0.0)).alias("gain")
        )
        steps = table(steps, "given")
        st.open(must_open)
        quota = must_open.groupBy(*k).agg((F.lit(p) - F.count(F.lit(1))).alias("_q"))
    for step in range(1, p + 1):
        pool = st.scores()
        if quota is not None:
            pool = pool.join(quota, k, "left").where(F.coalesce("_q", F.lit(p)) >= step)
        pick = table(best_site(pool, k), "pick")
        if pick.isEmpty():
            break
        row = pick.select(*k, F.lit(step).alias("step"), "site_id", "gain")
        steps = row if steps is None else steps.unionByName(row)
        if step < p:
            st.open(pick)
    if steps is None:
        return _none(pairs, k, step="int", site_id="bigint", gain="double")
    return steps


def greedy_budget(pairs: Relation, costs: DataFrame, budget: float, keys: Sequence[str] = ("aoi_id",)) -> DataFrame:
    """Best gain per cost while affordable, or the best single site if that covers more."""
    k = list(keys)
    c = costs.select(*k, "site_id", F.col("cost").alias("price"))
    st = _gains(pairs, k)
    gains = st.scores().join(c, [*k, "site_id"]).where(F.col("price") <= budget)
    single = table(best_site(gains, k, extra=["price"]), "single")
    steps = None
    spent = None
    for step in count(1):  # a round spends money, so it ends
        g = st.scores().join(c, [*k, "site_id"])
        g = g.join(spent, k, "left") if spent is not None else g.withColumn("spent", F.lit(0.0))
        used = F.coalesce("spent", F.lit(0.0))
        g = g.where((used + F.col("price") <= budget) & (F.col("gain") > 0)).withColumn("ratio", F.round(F.col("gain") / F.col("price"), 6))
        pick = best_site(g.withColumn("_u", used), k, "ratio", extra=["gain", "price", "_u"])
        pick = table(pick.select(*k, F.lit(step).alias("step"), "site_id", "gain", (F.col("_u") + F.col("price")).alias("spent")), "pick")
        if pick.isEmpty():
            break
        steps = pick if steps is None else steps.unionByName(pick)
        spent = pick.select(*k, "spent") if spent is None else table(
            spent.unionByName(pick.select(*k, "spent")).groupBy(*k).agg(F.max("spent").alias("spent")), "spent"
        )
        st.open(pick)
    if steps is None:
        return _none(pairs, k, step="int", site_id="bigint", gain="double", spent="double")
    tot = steps.groupBy(*k).agg(F.sum("gain").alias("_sum"))
    use_single = single.join(tot, k).where(F.col("gain") > F.col("_sum"))
    solo = use_single.select(*k, F.lit(1).alias("step"), "site_id", "gain", F.col("price").alias("spent"))
    return steps.join(use_single.select(*k), k, "left_anti").unionByName(solo)


def _held(left: DataFrame, sites: DataFrame, radius_m: float, k: list[str]) -> DataFrame:
    """(keys, site_id, demand_id, weight): what each site serves, its closest demand while it fits."""
    from ..operators.running import running_totals

    pairs = pairs_within(left, sites, radius_m, k).select(*k, "demand_id", "site_id", "weight", "capacity", "dist_m")
    run = running_totals(table(pairs, "reached"), [*k, "site_id"], "dist_m", ["weight"], tie=["demand_id"])
    return run.where(F.round("cum_weight", 6) <= F.round("capacity", 6)).select(*k, "site_id", "demand_id", "weight")


def _best_held(left: DataFrame, sites: DataFrame, radius_m: float, k: list[str], fine: int) -> DataFrame:
    """(keys, site_id) of the site that serves most within its capacity.

    A site that holds all it reaches serves just that; one that does not fills up to less
    than one demand.  Only of the latter kind, and where they may still be the best, are
    pairs looked at one by one, ``PAIRS_AT_ONCE`` or about as many at a time.
    """
    at = sites.select(*k, "site_id", "lon", "lat", F.lit(float(radius_m)).alias("reach"))
    points = left.select(*k, "lon", "lat", "weight", F.lit(1).cast("bigint").alias("n"))
    reached = rows_in_reach(points, at, "reach", radius_m, k, [], ["weight", "n"], fine)
    reached = reached.groupBy(*k, "site_id").agg(F.sum("weight").alias("w"), F.sum("n").alias("n"))
    room = sites.groupBy(*k, "site_id").agg(F.min("capacity").alias("lo"), F.max("capacity").alias("hi"))
    odd = F.count(F.when(F.col("weight").isNull() | (F.col("weight") < 0), 1))
    most = left.groupBy(*k).agg(F.max("weight").alias("most"), odd.alias("odd"))
    b = reached.join(room.where("lo is not null"), [*k, "site_id"]).join(most, k)
    # sums of doubles differ in their last bits
    slack = F.abs("w") * 1e-9 + 1e-3
    sure = (F.col("odd") == 0) & (F.col("lo") == F.col("hi"))
    whole = sure & (F.col("w") + slack <= F.col("lo"))
    most_of = F.when(whole, F.round("w", GAIN_DIGITS)).when(sure, F.least("w", "lo") + slack).otherwise(F.lit(float("inf")))
    least_of = F.when(whole, F.round("w", GAIN_DIGITS)).when(sure, F.col("lo") - F.col("most") - slack).otherwise(F.lit(float("-inf")))
    b = table(b.select(*k, "site_id", "n", F.coalesce(whole, F.lit(False)).alias("whole"), least_of.alias("least"), most_of.alias("upmost")), "bounds")
    cut = b.groupBy(*k).agg(F.max("least").alias("cut"))
    may = table(b.join(cut, k).where(F.col("upmost") >= F.col("cut")), "may")
    gains = may.where("whole").select(*k, "site_id", F.col("least").alias("gain"))
    n = may.where("not whole").agg(F.sum("n")).first()[0] or 0
    parts = -(-n // PAIRS_AT_ONCE)
    for i in range(parts):
        best = gains.groupBy(*k).agg(F.max("gain").alias("_best"))
        todo = may.where(~F.col("whole") & (F.pmod(F.xxhash64("site_id"), F.lit(parts)) == i)).join(best, k, "left")
        todo = table(todo.where(F.col("_best").isNull() | (F.col("upmost") >= F.col("_best"))).select(*k, "site_id"), "todo")
        held = _held(left, sites.join(todo, [*k, "site_id"], "left_semi"), radius_m, k)
        judged = held.groupBy(*k, "site_id").agg(F.round(F.sum("weight"), GAIN_DIGITS).alias("gain"))
        gains = table(gains.unionByName(judged), "gains")
    return table(best_site(gains, k).select(*k, "site_id"), "pick")


def greedy_capacity(
    demand: DataFrame, sites: DataFrame, radius_m: float, p: int, keys: Sequence[str] = ("aoi_id",), capacity: bool = True
) -> DataFrame:
    """Capacitated MCLP: a site serves its closest uncovered demand while it fits.

    Returns assignments (keys, step, site_id, demand_id, weight).  Without a
    capacity column every site gets total weight / p.
    """
    k = list(keys)
    s = sites
    if not capacity:
        avg = demand.groupBy(*k).agg((F.sum("weight") / F.lit(float(max(p, 1)))).alias("capacity"))
        s = sites.drop("capacity").join(avg, k)
    left = table(demand.select(*k, "demand_id", "lon", "lat", "weight"), "left")
    s = table(s.select(*k, "site_id", "lon", "lat", "capacity"), "sites")
    fine = rim_cells(left, radius_m, k)
    out = None
    for step in range(1, p + 1):
        pick = _best_held(left, s, radius_m, k, fine)
        if pick.isEmpty():
            break
        held = _held(left, s.join(pick, [*k, "site_id"], "left_semi"), radius_m, k)
        got = table(held.select(*k, F.lit(step).alias("step"), "site_id", "demand_id", "weight"), "served")
        out = got if out is None else out.unionByName(got)
        if step < p:
            rest = table(left.join(sorted_in(got.select(*k, "demand_id")), [*k, "demand_id"], "left_anti"), "left")
            more = table(s.join(pick, [*k, "site_id"], "left_anti"), "sites")
            release(left, s)
            left, s = rest, more
    if out is None:
        return _none(s, k, step="int", site_id="bigint", demand_id="bigint", weight="double")
    return out


def mclp_bound(pairs: Relation, steps: DataFrame, p: int, keys: Sequence[str] = ("aoi_id",)) -> DataFrame:
    """Covered value of the greedy set plus its p largest remaining gains.

    A valid upper bound for the classical and probabilistic models, whose gains
    only shrink as sites open.
    """
    from ..operators.measures import top_n

    k = list(keys)
    have = steps.groupBy(*k).agg(F.sum("gain").alias("value"))
    if isinstance(pairs, Reach):
        rest = ReachGains(pairs.opened(steps), classic_gain).table.where("n > 0").select(*k, "site_id", "gain")
    else:
        rest = open_sites(pairs, steps, k).groupBy(*k, "site_id").agg(F.sum(_gain()).alias("gain"))
    more = top_n(rest, k, [F.desc("gain"), F.asc("site_id")], p).groupBy(*k).agg(F.sum("gain").alias("_more"))
    return have.join(more, k, "left").select(
        *k, F.round("value", 2).alias("value"), F.round(F.col("value") + F.coalesce("_more", F.lit(0.0)), 2).alias("upper_bound")
    )


def local_winners(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sites whose gain is the largest around every demand they still serve.

    No two winners share a demand, so opening all of them at once gives the same
    set as opening the global best one by one.
    """
    k = list(keys)
    score = pairs.groupBy(*k, "site_id").agg(_score().alias("gain"))
    rank = F.struct("gain", (-F.col("site_id")).alias("i"))
    scored = pairs.select(*k, "demand_id", "site_id").join(sorted_in(score), [*k, "site_id"]).withColumn("_r", rank)
    top = scored.groupBy(*k, "demand_id").agg(F.max("_r").alias("_top"))
    judged = scored.join(sorted_in(top), [*k, "demand_id"]).groupBy(*k, "site_id").agg(
        F.min((F.col("_r") == F.col("_top")).cast("int")).alias("_win"), F.max("gain").alias("gain")
    )
    return judged.where("_win = 1").drop("_win")


def greedy_cover(
    pairs: Relation,
    keys: Sequence[str] = ("aoi_id",),
    seed: DataFrame | None = None,
) -> DataFrame:
    """Greedy set cover of every coverable demand: (keys, round, site_id).

    A Reach is written as pairs once few enough are left; until then a round opens the
    sites that are best within twice the reach, which are some of the local winners.
    """
    k = list(keys)
    out = None
    if seed is not None:
        out = seed.select(*k, F.lit(0).alias("round"), "site_id")
    rounds = count(1)
    if isinstance(pairs, Reach):
        st = ReachGains(pairs, classic_gain)
        if seed is not None:
            st.open(seed)
        while st.n_pairs() > PAIRS_AT_ONCE:  # the best site of all wins, so it ends
            win = table(st.winners(), "winners")
            row = win.select(*k, F.lit(next(rounds)).alias("round"), "site_id")
            out = row if out is None else out.unionByName(row)
            st.open(win)
        pairs = table(st.left().pairs(), "pairs")
    elif seed is not None:
        pairs = open_sites(pairs, seed, k)
    for r in rounds:  # a round opens a site, so it ends
        win = table(local_winners(pairs, k), "winners")
        if win.isEmpty():
            break
        row = win.select(*k, F.lit(r).alias("round"), "site_id")
        out = row if out is None else out.unionByName(row)
        pairs = open_sites(pairs, win, k)
    if out is None:
        return _none(pairs, k, round="int", site_id="bigint")
    return table(out, "cover")


def drop_redundant(pairs: Relation, cover: DataFrame, keys: Sequence[str] = ("aoi_id",), keep: DataFrame | None = None) -> DataFrame:
    """Close sites whose every demand stays covered without them.

    Sites that share a demand never close in the same round.
    """
    k = list(keys)
    cov = cover.select(*k, "site_id")
    cur = table(_of_sites(pairs, cov, k), "active")
    while True:  # a round closes a site, so it ends
        tot = cur.groupBy(*k, "demand_id").agg(F.sum("coef").alias("_tot"))
        spare = cur.join(sorted_in(tot), [*k, "demand_id"]).withColumn("_ok", (F.col("_tot") - F.col("coef") >= F.col("need") - EPS).cast("int"))
        idle = spare.groupBy(*k, "site_id").agg(F.min("_ok").alias("_ok"), F.count(F.lit(1)).alias("_n")).where("_ok = 1")
        if keep is not None:
            idle = idle.join(keep.select(*k, "site_id"), [*k, "site_id"], "left_anti")
        r = F.struct((-F.col("_n")).alias("a"), F.col("site_id").alias("b"))
        ranked = cur.select(*k, "demand_id", "site_id").join(sorted_in(idle), [*k, "site_id"]).withColumn("_r", r)
        top = ranked.groupBy(*k, "demand_id").agg(F.max("_r").alias("_top"))
        gone = ranked.join(sorted_in(top), [*k, "demand_id"]).groupBy(*k, "site_id").agg(
            F.min((F.col("_r") == F.col("_top")).cast("int")).alias("_win")
        ).where("_win = 1").select(*k, "site_id")
        gone = table(gone, "gone")
        if gone.isEmpty():
            break
        cur = table(cur.join(gone, [*k, "site_id"], "left_anti"), "active")
        cov = table(cov.join(gone, [*k, "site_id"], "left_anti"), "cover")
    return cov


def set_cover(
    pairs: Relation, keys: Sequence[str] = ("aoi_id",), must_open: DataFrame | None = None, must_close: DataFrame | None = None
) -> DataFrame:
    """Fewest sites found that cover all coverable demand: (keys, site_id, forced).

    Sites of ``must_open`` (keys, site_id) are open whatever they cover and are never
    closed as spare; sites of ``must_close`` stay shut.  A site in both is open.  Demand that
    only shut sites reach stays uncovered: pass the result to ``cover_status``.
    """
    k = list(keys)
    opened = None if must_open is None else table(must_open.select(*k, "site_id").distinct(), "given")
    if must_close is not None:
        shut = must_close.select(*k, "site_id")
        shut = shut if opened is None else shut.join(opened, [*k, "site_id"], "left_anti")
        pairs = pairs.like(sites=table(pairs.without(shut).sites, "sites")) if isinstance(pairs, Reach) else table(_without(pairs, shut, k), "pairs")
    lean = drop_redundant(pairs, greedy_cover(pairs, k, seed=opened), k, keep=opened)
    if opened is None:
        return lean.withColumn("forced", F.lit(False))
    mark = opened.withColumn("forced", F.lit(True))
    return lean.join(mark, [*k, "site_id"], "left").withColumn("forced", F.coalesce("forced", F.lit(False)))


def _pack_near(reach: Reach, k: Sequence[str]) -> tuple[DataFrame | None, DataFrame]:
    """Rounds of ``packing_bound`` by place, until few pairs are left: (packed so far, those pairs with ``_deg``).

    Demand that is first within twice the reach is first among all it shares a site with. All sites reach ``widest`` metres.
    """
    found, name = None, [*k, "demand_id"]
    sites = reach.sites.select(*k, "site_id", "lon", "lat")
    copies = sites.withColumn("count", F.lit(1).cast("bigint"))
    spots = reach.spots.select(*name, "lon", "lat", F.lit(reach.widest).alias("reach"))
    rows = rows_in_reach(copies, spots, "reach", reach.widest, k, [], ["count"], reach.fine)
    deg = rows.groupBy(*name).agg(F.sum("count").alias("_deg"))
    cur = table(spots.drop("reach").join(sorted_in(deg), name), "packing")
    while (cur.agg(F.sum("_deg")).first()[0] or 0) > PAIRS_AT_ONCE:  # the first of all is taken, so it ends
        ranked = cur.withColumn("_rank", F.struct((-F.col("_deg")).alias("a"), (-F.col("demand_id")).alias("b")))
        win = table(peaks(ranked, 2 * reach.widest + 0.01, k, "demand_id", "_rank"), "packed")
        found = win if found is None else found.unionByName(win)
        at = cur.join(win, name).select(*k, "lon", "lat")
        taken = table(pairs_within(sites, at, reach.widest, k).select(*k, "site_id", "lon", "lat").distinct(), "taken")
        near = beside(cur, at, 2 * reach.widest + 0.01, k).withColumn("reach", F.lit(reach.widest))
        hit = rows_in_reach(taken.withColumn("count", F.lit(1)), near, "reach", reach.widest, k, [], ["count"], reach.fine).select(*name).distinct()
        cur, old = table(cur.join(sorted_in(hit), name, "left_anti"), "packing"), cur
        release(old, taken)
    pairs = pairs_within(cur, sites, reach.widest, k)
    return found, pairs.select(*name, "site_id", "_deg")


def packing_bound(pairs: Relation, keys: Sequence[str] = ("aoi_id",), k_cover: int = 1) -> DataFrame:
    """(keys, lower_bound): demands no two of which share a site, found in parallel.

    Each needs its own site(s), so their number (x k) bounds any cover from below.
    """
    k = list(keys)
    found = None
    if isinstance(pairs, Reach):
        found, pairs = _pack_near(pairs, k)
    cur = pairs.select(*k, "demand_id", "site_id")
    if "_deg" in pairs.columns:
        cur = pairs
    else:
        deg = cur.groupBy(*k, "demand_id").agg(F.count(F.lit(1)).alias("_deg"))
        cur = cur.join(sorted_in(deg), [*k, "demand_id"])
    cur = table(cur.withColumn("_r", F.struct("_deg", "demand_id")), "packing")
    while True:  # a round takes a demand, so it ends
        low = cur.groupBy(*k, "site_id").agg(F.min("_r").alias("_low"))
        win = cur.join(sorted_in(low), [*k, "site_id"]).groupBy(*k, "demand_id").agg(
            F.min((F.col("_r") == F.col("_low")).cast("int")).alias("_win")
        ).where("_win = 1").select(*k, "demand_id")
        win = table(win, "packed")
        if win.isEmpty():
            break
        found = win if found is None else found.unionByName(win)
        taken = cur.join(win, [*k, "demand_id"], "left_semi").select(*k, "site_id").distinct()
        hit = cur.join(taken, [*k, "site_id"]).select(*k, "demand_id").distinct()
        cur = table(cur.join(sorted_in(hit), [*k, "demand_id"], "left_anti"), "packing")
    if found is None:
        return _none(pairs, k, lower_bound="bigint")
    return found.groupBy(*k).agg((F.count(F.lit(1)) * k_cover).alias("lower_bound"))


def log_need(alpha: float) -> float:
    return -math.log(1.0 - alpha)


def log_coef(col: str = "reliability"):
    return -F.log1p(-F.least(F.coalesce(F.col(col), F.lit(1.0)), F.lit(1.0 - 1e-9)))


def partial_cover(pairs: Relation, totals: DataFrame, fraction: float, keys: Sequence[str] = ("aoi_id",)) -> DataFrame:
    """Best gain per round until the covered weight reaches the fraction.

    ``totals`` holds (keys, total) with the weight of all demand, coverable or not.
    """
    k = list(keys)
    goal = totals.select(*k, (F.col("total") * F.lit(fraction)).alias("_goal"))
    have = table(totals.select(*k, F.lit(0.0).alias("have")), "have")
    st = _gains(pairs, k)
    steps = None
    for step in count(1):  # a round opens a site, so it ends
        short = have.join(goal, k).where(F.round("have", 4) < F.round("_goal", 4)).select(*k)
        pick = table(best_site(st.scores().join(short, k, "left_semi"), k), "pick")
        if pick.isEmpty():
            break
        row = pick.select(*k, F.lit(step).alias("step"), "site_id", "gain")
        steps = row if steps is None else steps.unionByName(row)
        have = table(have.join(pick.select(*k, "gain"), k, "left").select(*k, (F.col("have") + F.coalesce("gain", F.lit(0.0))).alias("have")), "have")
        st.open(pick)
    if steps is None:
        return _none(pairs, k, step="int", site_id="bigint", gain="double")
    return steps


def cover_status(demand: DataFrame, sites: DataFrame, pairs: Relation, chosen: DataFrame, keys: Sequence[str] = ("aoi_id",)) -> DataFrame:
    """A row for every key that has demand: (keys, status, n_sites, n_demand, n_uncovered, uncovered_weight).

    ``chosen`` (keys, site_id) is what a model opened over ``pairs``.  Status: feasible
    (all demand has what it needs), infeasible, or no candidates.
    """
    k = list(keys)
    spots = demand_spots(demand, k)
    given = _of_sites(pairs, chosen, k).groupBy(*k, "demand_id").agg(F.sum("coef").alias("_given"), F.max("need").alias("_need"))
    met = given.where(F.col("_given") >= F.col("_need") - EPS).select(*k, "demand_id", F.lit(True).alias("_met"))
    out = spots.join(sorted_in(met), [*k, "demand_id"], "left").groupBy(*k).agg(
        F.sum("n_points").alias("n_demand"),
        F.coalesce(F.sum(F.when(F.col("_met").isNull(), F.col("n_points"))), F.lit(0)).alias("n_uncovered"),
        F.round(F.coalesce(F.sum(F.when(F.col("_met").isNull(), F.col("weight"))), F.lit(0.0)), GAIN_DIGITS).alias("uncovered_weight"),
    )
    out = out.join(sites.select(*k).distinct().withColumn("_any", F.lit(True)), k, "left")
    out = out.join(chosen.groupBy(*k).agg(F.count(F.lit(1)).alias("n_sites")), k, "left")
    status = F.when(F.col("_any").isNull(), "no candidates").when(F.col("n_uncovered") > 0, "infeasible").otherwise("feasible")
    return out.select(*k, status.alias("status"), F.coalesce("n_sites", F.lit(0)).cast("bigint").alias("n_sites"), "n_demand", "n_uncovered", "uncovered_weight")
