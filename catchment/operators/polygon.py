"""Point-in-polygon by even-odd crossings, with cell and band prefilters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

CELL_DEG = 1.0
BAND_DEG = 0.05


def points_in_polygons(
    points: DataFrame,
    edges: DataFrame,
    point_key: Sequence[str],
    poly_key: Sequence[str] = ("aoi_id",),
    x: str = "lon",
    y: str = "lat",
    cell_deg: float = CELL_DEG,
    band_deg: float = BAND_DEG,
) -> DataFrame:
    """(point_key, poly_key) for every point strictly inside a polygon.

    Polygons are looked up by the cells of their box; crossings are then counted
    only against edges of the point's own latitude band.  ``point_key`` and
    ``poly_key`` must not share names.
    """
    pk, gk = list(point_key), list(poly_key)
    box = edges.groupBy(*gk).agg(
        F.least(F.min("x1"), F.min("x2")).alias("bx0"), F.greatest(F.max("x1"), F.max("x2")).alias("bx1"),
        F.least(F.min("y1"), F.min("y2")).alias("by0"), F.greatest(F.max("y1"), F.max("y2")).alias("by1"),
    )

    def cell(c, deg):
        return F.floor(c / F.lit(deg))

    boxes = box.withColumn("_cx", F.explode(F.sequence(cell(F.col("bx0"), cell_deg), cell(F.col("bx1"), cell_deg)))).withColumn(
        "_cy", F.explode(F.sequence(cell(F.col("by0"), cell_deg), cell(F.col("by1"), cell_deg)))
    )
    p = points.select(*pk, F.col(x).alias("_x"), F.col(y).alias("_y"))
    near = (
        p.withColumn("_cx", cell(F.col("_x"), cell_deg)).withColumn("_cy", cell(F.col("_y"), cell_deg))
        .join(boxes, ["_cx", "_cy"])
        .where("_x between bx0 and bx1 and _y between by0 and by1")
        .select(*pk, *gk, "_x", "_y", cell(F.col("_y"), band_deg).alias("_band"))
    )
    lo, hi = F.least("y1", "y2"), F.greatest("y1", "y2")
    banded = edges.where("y1 <> y2").select(
        *gk, "x1", "y1", "x2", "y2",
        F.explode(F.sequence(cell(lo, band_deg), cell(hi, band_deg))).alias("_band"),
    )
    straddles = (F.col("y1") > F.col("_y")) != (F.col("y2") > F.col("_y"))
    cross_x = F.col("x1") + (F.col("_y") - F.col("y1")) / (F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1"))
    hits = near.join(banded, [*gk, "_band"]).where(straddles & (cross_x > F.col("_x")))
    return hits.groupBy(*pk, *gk).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") % 2 == 1).drop("_n")


def clip_to_own_polygon(points: DataFrame, edges: DataFrame, point_id: str, keys=("aoi_id",)) -> DataFrame:
    """Points of each key that lie inside that key's own polygon."""
    k = list(keys)
    tagged = edges.withColumnsRenamed({c: f"_g_{c}" for c in k})
    inside = points_in_polygons(points, tagged, [*k, point_id], [f"_g_{c}" for c in k])
    for c in k:
        inside = inside.where(F.col(c) == F.col(f"_g_{c}"))
    return points.join(inside.select(*k, point_id), [*k, point_id], "left_semi")


def self_crossings(edges: DataFrame, keys=("aoi_id",), band_deg: float = BAND_DEG) -> DataFrame:
    """Per polygon: whether two edges cross in their interiors.

    Edges meet only edges of a cell both pass through, never all of a ring.
    """
    k = list(keys)

    def cells(lo, hi):
        return F.explode(F.sequence(F.floor(lo / F.lit(band_deg)), F.floor(hi / F.lit(band_deg))))

    e = edges.select(*k, "seq", "x1", "y1", "x2", "y2")
    e = e.withColumn("_cx", cells(F.least("x1", "x2"), F.greatest("x1", "x2"))).withColumn(
        "_cy", cells(F.least("y1", "y2"), F.greatest("y1", "y2"))
    )
    a, b = e.alias("a"), e.alias("b")

    def turn(px, py, qx, qy, rx, ry):
        return (F.col(qx) - F.col(px)) * (F.col(ry) - F.col(py)) - (F.col(qy) - F.col(py)) * (F.col(rx) - F.col(px))

    t1 = turn("a.x1", "a.y1", "a.x2", "a.y2", "b.x1", "b.y1")
    t2 = turn("a.x1", "a.y1", "a.x2", "a.y2", "b.x2", "b.y2")
    t3 = turn("b.x1", "b.y1", "b.x2", "b.y2", "a.x1", "a.y1")
    t4 = turn("b.x1", "b.y1", "b.x2", "b.y2", "a.x2", "a.y2")
    same = (F.col("a._cx") == F.col("b._cx")) & (F.col("a._cy") == F.col("b._cy"))
    for c in k:
        same = same & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    bad = a.join(b, same & (F.col("a.seq") < F.col("b.seq"))).where((t1 * t2 < 0) & (t3 * t4 < 0)).select(
        *[F.col(f"a.{c}").alias(c) for c in k]
    ).distinct().withColumn("self_intersects", F.lit(True))
    return edges.select(*k).distinct().join(bad, k, "left").withColumn(
        "self_intersects", F.coalesce("self_intersects", F.lit(False))
    )
