"""Cover relations that are never written: demand spots, sites and how far each site reaches.

A ``Reach`` stands for the pairs that ``cover.cover_pairs`` would write.  Gains are sums
over all demand within a site's reach, so they come from sums of grid cells and from the
points on the rim (``rows_in_reach``); opening sites reads only what lies around them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..operators.coverage import beside, pairs_within, peaks, rim_cells, rows_in_reach
from ..session import release
from .common import GAIN_DIGITS, sorted_in, table

EPS = 1e-9


class Reach:
    """``spots`` (keys, demand_id, lon, lat, value, need) and ``sites`` (keys, site_id, lon, lat, coef, reach)."""

    def __init__(self, spots: DataFrame, sites: DataFrame, widest_m: float, keys: Sequence[str], fine: int | None = None):
        self.keys, self.widest = list(keys), float(widest_m)
        self.spots, self.sites = spots, sites
        self.fine = fine or rim_cells(spots, self.widest, self.keys)

    def like(self, spots: DataFrame | None = None, sites: DataFrame | None = None) -> "Reach":
        return Reach(self.spots if spots is None else spots, self.sites if sites is None else sites, self.widest, self.keys, self.fine)

    def only(self, sites: DataFrame) -> "Reach":
        return self.like(sites=self.sites.join(sites.select(*self.keys, "site_id"), [*self.keys, "site_id"]))

    def without(self, sites: DataFrame) -> "Reach":
        return self.like(sites=self.sites.join(sites.select(*self.keys, "site_id"), [*self.keys, "site_id"], "left_anti"))

    def pairs(self) -> DataFrame:
        """The relation row by row, for few sites or little demand."""
        near = pairs_within(self.spots, self.sites, self.widest, self.keys).where(F.col("dist_m") <= F.col("reach"))
        return near.select(*self.keys, "demand_id", "site_id", "value", "coef", "need")

    def opened(self, picks: DataFrame) -> "Reach":
        """What still matters after opening ``picks``: less need, fewer sites."""
        k = self.keys
        given = self.only(picks).pairs().groupBy(*k, "demand_id").agg(F.sum("coef").alias("_given"))
        left = self.spots.join(sorted_in(given), [*k, "demand_id"], "left").withColumn("need", F.col("need") - F.coalesce("_given", F.lit(0.0))).drop("_given")
        return self.like(table(left.where(F.col("need") > EPS), "spots"), table(self.without(picks).sites, "sites"))


class ReachGains:
    """``cover.Gains`` over a Reach: what every closed site would gain, corrected by differences as sites open."""

    def __init__(self, reach: Reach, gain):
        self.reach, self.keys, self.gain = reach, reach.keys, gain
        rows = self._near(reach.spots.withColumn("count", F.lit(1).cast("bigint")), reach.sites, ["need"])
        self.table = table(rows.groupBy(*self.keys, "site_id").agg(F.sum(self._of("need")).alias("gain"), F.sum(self._open("need")).alias("n")), "gains")
        self.old: DataFrame | None = None

    def _near(self, points: DataFrame, sites: DataFrame, state: Sequence[str]) -> DataFrame:
        r = self.reach
        return rows_in_reach(points, sites, "reach", r.widest, self.keys, state, ["value", "count"], r.fine)

    def _of(self, need: str):
        n = F.col(need)
        return F.when(n > EPS, self.gain(F.col("value"), n, F.col("coef"))).otherwise(F.lit(0.0))

    def _open(self, need: str):
        return F.when(F.col(need) > EPS, F.col("count")).otherwise(F.lit(0).cast("bigint"))

    def scores(self) -> DataFrame:
        """(keys, site_id, gain) of sites that gain anything."""
        scores = self.table.select(*self.keys, "site_id", F.round("gain", GAIN_DIGITS).alias("score")).where("score > 0")
        return scores.withColumnRenamed("score", "gain")

    def open(self, picks: DataFrame) -> None:
        k, r = self.keys, self.reach
        picks = picks.select(*k, "site_id").distinct()
        at = r.sites.join(picks, [*k, "site_id"])
        given = r.like(sites=at).pairs().groupBy(*k, "demand_id").agg(F.sum("coef").alias("_given"))
        hit = table(r.spots.join(sorted_in(given), [*k, "demand_id"]).withColumn("_left", F.col("need") - F.col("_given")).drop("_given"), "hit")
        sites = beside(r.sites, at, 2 * r.widest + 0.01, k)
        rows = self._near(hit.withColumn("count", F.lit(1).cast("bigint")), sites, ["need", "_left"])
        change = rows.groupBy(*k, "site_id").agg(
            F.sum(self._of("_left") - self._of("need")).alias("_d"), F.sum(self._open("_left") - self._open("need")).alias("_m")
        )
        gains = self.table.join(picks, [*k, "site_id"], "left_anti").join(sorted_in(change), [*k, "site_id"], "left")
        gains = gains.select(*k, "site_id", (F.col("gain") + F.coalesce("_d", F.lit(0.0))).alias("gain"), (F.col("n") + F.coalesce("_m", F.lit(0))).alias("n"))
        seen = hit.select(*k, "demand_id", F.col("_left")).groupBy(*k, "demand_id").agg(F.min("_left").alias("_left"))
        spots = r.spots.join(sorted_in(seen), [*k, "demand_id"], "left").withColumn("need", F.coalesce("_left", "need")).drop("_left").where(F.col("need") > EPS)
        old = self.table, self.old
        self.table, self.old = table(gains, "gains"), table(spots, "spots")
        self.reach = r.like(spots=self.old)
        release(hit, *old)

    def n_pairs(self) -> int:
        """Pairs of closed sites with demand that still needs something."""
        return int(self.table.agg(F.sum("n")).first()[0] or 0)

    def left(self) -> Reach:
        """The relation of closed sites and demand that still needs something."""
        k = self.keys
        return self.reach.like(sites=self.reach.sites.join(self.table.where("n > 0").select(*k, "site_id"), [*k, "site_id"], "left_semi"))

    def winners(self) -> DataFrame:
        """(keys, site_id, gain) of sites whose gain is the largest within twice the reach, so around all demand they serve."""
        k = self.keys
        open_ = self.table.where("n > 0").select(*k, "site_id", F.round("gain", GAIN_DIGITS).alias("gain"))
        ranked = self.reach.sites.join(open_, [*k, "site_id"]).withColumn("_rank", F.struct("gain", (-F.col("site_id")).alias("i")))
        return peaks(ranked, 2 * self.reach.widest + 0.01, k, "site_id", "_rank").join(open_, [*k, "site_id"])
