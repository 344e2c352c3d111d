"""Convex hulls: partial hulls per partition, then one small merge per key."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F


def _chain(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Indices of the hull, counter-clockwise from the leftmost point."""
    order = np.lexsort((y, x))
    if len(order) < 3:
        return order

    def half(seq):
        out: list[int] = []
        for i in seq:
            while len(out) > 1:
                a, b = out[-2], out[-1]
                if (x[b] - x[a]) * (y[i] - y[a]) - (y[b] - y[a]) * (x[i] - x[a]) > 0:
                    break
                out.pop()
            out.append(i)
        return out

    low, up = half(order), half(order[::-1])
    return np.array(low[:-1] + up[:-1])


def convex_hull(points: DataFrame, keys: Sequence[str] = ("aoi_id",), x: str = "lon", y: str = "lat", directions: int = 16, groups: int = 512) -> DataFrame:
    """(keys, seq, x, y) of the hull.

    Points inside the polygon of the extreme points in a few directions cannot
    be on the hull and go first, with a plain aggregate; each partition then
    thins what is left to its own hull, and only hull points meet per key.
    """
    k = list(keys)
    p = points.select(*k, F.col(x).alias("x"), F.col(y).alias("y"))
    dirs = [(float(np.cos(t)), float(np.sin(t))) for t in np.arange(directions) * 2 * np.pi / directions]
    far = p.groupBy(*k).agg(*[F.max(F.struct((F.col("x") * c + F.col("y") * s).alias("d"), "x", "y")).alias(f"_e{i}") for i, (c, s) in enumerate(dirs)])
    outside = F.lit(False)
    for i in range(directions):
        a, b = F.col(f"_e{i}"), F.col(f"_e{(i + 1) % directions}")
        turn = (b["x"] - a["x"]) * (F.col("y") - a["y"]) - (b["y"] - a["y"]) * (F.col("x") - a["x"])
        # two directions with one extreme point have no edge between them
        same = (a["x"] == b["x"]) & (a["y"] == b["y"])
        corner = (F.col("x") == a["x"]) & (F.col("y") == a["y"])
        outside = outside | corner | (~same & (turn < 0))
    rest = p.join(far, k).where(outside).select(*k, "x", "y").distinct()
    schema = rest.schema

    def thin(frames):
        for f in frames:
            for _, g in f.groupby(k, sort=False):
                yield g.iloc[_chain(g["x"].to_numpy(), g["y"].to_numpy())]

    def merge(g: pd.DataFrame) -> pd.DataFrame:
        i = _chain(g["x"].to_numpy(), g["y"].to_numpy())
        return g.iloc[i].assign(seq=np.arange(len(i), dtype="int32"))

    def shrink(g: pd.DataFrame) -> pd.DataFrame:
        return g.iloc[_chain(g["x"].to_numpy(), g["y"].to_numpy())]

    # batches thin themselves, hashed groups thin again, so the last merge is small
    part = rest.mapInPandas(thin, schema).withColumn("_g", F.pmod(F.xxhash64("x", "y"), F.lit(groups)))
    part = part.groupBy(*k, "_g").applyInPandas(shrink, part.schema).drop("_g")
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", seq int"
    return part.groupBy(*k).applyInPandas(merge, out)
