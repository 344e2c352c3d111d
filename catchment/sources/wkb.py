"""Well-known binary geometry in Arrow batches."""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType


def _rings(b: bytes, at: int = 0) -> tuple[list[list[tuple[float, float]]], int, int]:
    """(rings, geometry type, next offset) of a point, line, polygon or multi geometry."""
    e = "<" if b[at] == 1 else ">"
    (kind,) = struct.unpack_from(e + "I", b, at + 1)
    at += 5 + 4 * bool(kind & 0x20000000)  # a spatial reference id may follow
    # Z and M as flag bits or as thousands of the type
    flags, kind = kind >> 30, kind & 0x0FFFFFFF
    axes = 2 + bool(flags & 2) + bool(flags & 1) + (0, 1, 1, 2)[kind // 1000 % 4]
    kind %= 1000

    def run(n, at):
        v = struct.unpack_from(f"{e}{axes * n}d", b, at)
        return list(zip(v[0::axes], v[1::axes])), at + 8 * axes * n

    if kind == 1:
        pts, at = run(1, at)
        return [pts], kind, at
    (n,) = struct.unpack_from(e + "I", b, at)
    at += 4
    if kind == 2:
        pts, at = run(n, at)
        return [pts], kind, at
    rings: list[list[tuple[float, float]]] = []
    for _ in range(n):
        if kind == 3:
            (m,) = struct.unpack_from(e + "I", b, at)
            pts, at = run(m, at + 4)
            rings.append(pts)
        else:
            more, _, at = _rings(b, at)
            rings += more
    return rings, kind, at


def geometry_edges(wkb: bytes) -> Iterator[tuple[int, int, float, float, float, float]]:
    """(ring_no, seq, x1, y1, x2, y2) of one geometry; a point gives one edge to itself."""
    for r, ring in enumerate(_rings(bytes(wkb))[0]):
        for i, (a, b) in enumerate(zip(ring, ring[1:]) if len(ring) > 1 else [(ring[0], ring[0])]):
            yield r, i, *a, *b


def decode_edges(df: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    """Boundary edges (keys, ring_no, seq, x1, y1, x2, y2); a point gives one edge to itself."""
    k = list(keys)
    base = df.select(*k, column)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema if f.name in k)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for rec in f.itertuples(index=False):
                vals, wkb = rec[:-1], rec[-1]
                if wkb is None:
                    continue
                rows += [(*vals, *edge) for edge in geometry_edges(wkb)]
            yield pd.DataFrame(rows, columns=[*k, "ring_no", "seq", "x1", "y1", "x2", "y2"])

    return base.mapInPandas(run, schema + ", ring_no int, seq int, x1 double, y1 double, x2 double, y2 double")


@F.pandas_udf(BinaryType())
def point_wkb(x: pd.Series, y: pd.Series) -> pd.Series:
    return pd.Series([struct.pack("<BIdd", 1, 1, a, b) for a, b in zip(x, y)])


@F.pandas_udf(BinaryType())
def ring_wkb(ring: pd.Series) -> pd.Series:
    """Polygon of one ring given as an array of (x, y) structs, first point repeated last."""
    out = []
    for pts in ring:
        flat = [c for p in pts for c in (p["x"], p["y"])]
        out.append(struct.pack(f"<BIII{len(flat)}d", 1, 3, 1, len(pts), *flat))
    return pd.Series(out)
