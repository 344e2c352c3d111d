"""Exact nearest-site join without comparing every point with every site.

Sites are put into a tree of cells: 4 x 4 children per node, as deep as the
densest spot needs.  A point starts at the root of its key (its AOI) and goes
down one level per round; each round is an equi-join on the node, keeps the
children whose lower bound beats the best upper bound, and drops the rest.  The
work per point grows with the depth of the tree, not with the number of sites,
and a hot spot of sites only makes its own branch deeper.

No side is forced to broadcast: Spark broadcasts a level when its size is under
the configured threshold and shuffles on the node key otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import geo
from ..session import materialize

_BITS = 2
_MAX_DEPTH = 12
_LEAF = 32
# bounds may be off by rounding; a tie after rounding to millimetres must survive
_SLACK_M = 0.002


class SiteTree:
    """Cell tree over distinct site coordinates, keyed by ``keys``."""

    def __init__(
        self,
        sites: DataFrame,
        keys: Sequence[str],
        site_id: str = "site_id",
        x: str = "lon",
        y: str = "lat",
        leaf: int = _LEAF,
        metric=geo.Haversine,
    ):
        self.keys = list(keys)
        self.metric = metric
        k = self.keys
        # copies at one coordinate count once; the lowest id stands for them
        pts = sites.groupBy(*k, F.col(x).alias("x"), F.col(y).alias("y")).agg(
            F.min(site_id).alias("site_id")
        )
        box = sites.groupBy(*k).agg(
            F.min(x).alias("bx0"), F.max(x).alias("bx1"), F.min(y).alias("by0"), F.max(y).alias("by1")
        )
        side = float(1 << (_BITS * _MAX_DEPTH))

        def index(v: str, lo: str, hi: str):
            span = F.col(hi) - F.col(lo)
            u = F.when(span > 0, (F.col(v) - F.col(lo)) / span).otherwise(F.lit(0.0))
            return F.least(F.floor(u * side), F.lit(int(side) - 1)).cast("bigint")

        pts = pts.join(box, k).select(
            *k, "site_id", "x", "y",
            index("x", "bx0", "bx1").alias("ix"), index("y", "by0", "by1").alias("iy"),
        )
        flat = metric.embed(F.col("x"), F.col("y"))
        self.axes = [f"a{i}" for i in range(len(flat))]
        pts = pts.select(*k, "site_id", "ix", "iy", *[c.alias(a) for a, c in zip(self.axes, flat)])
        pts = materialize(pts, "sites")
        self.depth = self._needed_depth(pts, leaf)
        sh = _BITS * (_MAX_DEPTH - self.depth)
        self._pts = pts.withColumn("cx", F.shiftright("ix", sh)).withColumn("cy", F.shiftright("iy", sh))

    def _needed_depth(self, pts: DataFrame, leaf: int) -> int:
        lv = F.explode(F.sequence(F.lit(0), F.lit(_MAX_DEPTH))).alias("lv")
        shift = f"{_BITS} * ({_MAX_DEPTH} - lv)"
        counts = (
            pts.select(*self.keys, "ix", "iy", lv)
            .groupBy(*self.keys, "lv", F.expr(f"shiftright(ix, {shift})"), F.expr(f"shiftright(iy, {shift})"))
            .count()
        )
        rows = counts.groupBy("lv").agg(F.max("count").alias("n")).collect()
        ok = [r["lv"] for r in rows if r["n"] <= leaf]
        return min(ok) if ok else _MAX_DEPTH

    def leaves(self) -> DataFrame:
        """The sites with their deepest cell."""
        return self._pts.select(*self.keys, "cx", "cy", F.col("site_id").alias("_sid"), *self.axes)

    def children(self, level: int) -> DataFrame:
        """Child cells (kx, ky) of the nodes of ``level`` with their tight boxes."""
        down = _BITS * (self.depth - level - 1)
        ends = [c for a in self.axes for c in (F.min(a).alias(f"{a}0"), F.max(a).alias(f"{a}1"))]
        kid = self._pts.groupBy(
            *self.keys, F.shiftright("cx", down).alias("kx"), F.shiftright("cy", down).alias("ky")
        ).agg(*ends)
        return kid.withColumn("cx", F.shiftright("kx", _BITS)).withColumn("cy", F.shiftright("ky", _BITS))


def nearest_site(
    points: DataFrame,
    sites: DataFrame | SiteTree,
    keys: Sequence[str] = ("aoi_id",),
    point_id: str = "demand_id",
    site_id: str = "site_id",
    x: str = "lon",
    y: str = "lat",
    metric=geo.Haversine,
    max_m: float | None = None,
    id_name: str = "site_id",
    dist_name: str = "dist_m",
) -> DataFrame:
    """``points`` with the id of and distance to the nearest site of the same key.

    Ties go to the lowest site id.  Points without any site (or none within
    ``max_m``) get nulls.  Distances are rounded to millimetres.
    """
    k = list(keys)
    tree = sites if isinstance(sites, SiteTree) else SiteTree(sites, k, site_id, x, y, metric=metric)
    metric = tree.metric
    carry = [c for c in points.columns if c not in (*k, point_id)]
    axes = [f"_p{a}" for a in tree.axes]
    lim = None if max_m is None else metric.reach(max_m + _SLACK_M)

    # one exchange on the point key serves every later round
    cur = points.repartition(*k, point_id)
    for name, col in zip(axes, metric.embed(F.col(x), F.col(y))):
        cur = cur.withColumn(name, col)
    zero = F.lit(0).cast("bigint")
    cur = cur.withColumn("cx", zero).withColumn("cy", zero)
    here = [F.col(a) for a in axes]
    ends = [(F.col(f"{a}0"), F.col(f"{a}1")) for a in tree.axes]

    def norm(gaps):
        return F.sqrt(sum((g * g for g in gaps), F.lit(0.0)))

    low = norm([F.greatest(F.lit(0.0), lo - p, p - hi) for p, (lo, hi) in zip(here, ends)])
    high = norm([F.greatest(F.abs(lo - p), F.abs(hi - p)) for p, (lo, hi) in zip(here, ends)])
    keep = [*k, point_id, *carry, *axes]
    own = Window.partitionBy(*k, point_id)
    for level in range(tree.depth):
        cur = cur.join(tree.children(level), [*k, "cx", "cy"], "left")
        cur = cur.select(*keep, "kx", "ky", low.alias("_lb"), high.alias("_ub"))
        top = F.min("_ub").over(own) * metric.stretch + _SLACK_M
        if lim is not None:
            top = F.least(top, F.lit(lim))
        cur = cur.withColumn("_top", top).withColumn("_near", F.min("_lb").over(own))
        # the closest cell stays in any case, so a point with nothing in reach keeps a row
        cur = cur.where(F.col("kx").isNull() | (F.col("_lb") <= F.col("_top")) | (F.col("_lb") == F.col("_near")))
        cur = cur.select(*keep, F.col("kx").alias("cx"), F.col("ky").alias("cy"))
    cur = cur.join(tree.leaves(), [*k, "cx", "cy"], "left")
    dist = metric.between(here, [F.col(a) for a in tree.axes])
    pair = F.when(F.col("_sid").isNotNull(), F.struct(dist.alias("d"), F.col("_sid").alias("s")))
    cur = cur.withColumn("hit", pair).groupBy(*k, point_id).agg(
        *[F.first(c).alias(c) for c in carry], F.min("hit").alias("hit")
    )
    hit = F.col("hit")
    if max_m is not None:
        hit = F.when(F.col("hit.d") <= max_m, F.col("hit"))
    cur = cur.withColumn("hit", hit)
    return cur.select(
        *points.columns, F.col("hit.s").alias(id_name), F.col("hit.d").alias(dist_name)
    )
