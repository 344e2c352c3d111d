"""Siting tables derived from the driver tables.

Every view is one list of column expressions over one FROM clause; the same
text serves Spark (``selectExpr``) and the DuckDB oracle (a CTE), so both
engines see equal inputs at every scale factor.  Double literals carry an
exponent because a bare ``0.8`` is DECIMAL in both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

_AOI = "concat('R', cast(n_regionkey as string)) as aoi_id"
_X0 = "(-60e0 + 30e0*n_regionkey)"
_Y0 = "(-20e0 + 15e0*n_regionkey)"

DEMAND = [
    _AOI,
    "c_custkey as demand_id",
    f"{_X0} + cast((c_custkey*7919)%10007 as double)/10007e0*0.8e0 as lon",
    f"{_Y0} + cast((c_custkey*104729)%10009 as double)/10009e0*0.6e0 as lat",
    "case when c_acctbal > 0e0 then c_acctbal else 0e0 end + 1e0 as weight",
]
CANDIDATES = [
    _AOI,
    "s_suppkey as site_id",
    f"{_X0} + cast((s_suppkey*6007)%1009 as double)/1009e0*0.8e0 as lon",
    f"{_Y0} + cast((s_suppkey*3001)%1013 as double)/1013e0*0.6e0 as lat",
    "1000e0 + 500e0*((s_suppkey*37)%11) as capacity",
    "100e0 + 25e0*((s_suppkey*53)%17) as cost",
    "0.70e0 + 0.05e0*(s_suppkey%6) as reliability",
]
POI_A = [
    "aoi_id",
    "site_id as poi_id",
    "concat('Site ', cast(site_id as string), ' Clinic') as name",
    "case site_id%4 when 0 then 'hospital' when 1 then 'clinic' when 2 then 'school' else 'bank' end as amenity",
    "lon",
    "lat",
]
POI_B = [
    "aoi_id",
    "100000000 + site_id as poi_id",
    "case site_id%3 when 1 then 'Depot North' else concat('site ', cast(site_id as string), ' clinic st.') end as name",
    "case site_id%4 when 0 then 'hospital' when 1 then 'clinic' when 2 then 'school' else 'bank' end as amenity",
    "lon",
    "lat + case site_id%3 when 2 then 0.01e0 else 0.0002e0 end as lat",
]
ACTIVITY = [
    "cast(user_id as string) as session_id",
    "event_id",
    "cast(ts as timestamp) as ts",
    "event_type as stage",
    "case when event_type='error' then 'fail' when value < 10e0 then 'try' else 'ok' end as status",
    "value as duration_ms",
]
BOUNDARY = [
    "concat('R', cast(r_regionkey as string)) as aoi_id",
    "r_name as name",
    "-60e0 + 30e0*r_regionkey as ox",
    "-20e0 + 15e0*r_regionkey as oy",
]
RING = [(0.05, 0.05), (0.75, 0.05), (0.75, 0.55), (0.40, 0.30), (0.05, 0.55)]

#: Levels of the road quadtree: cells of 1/64 of an AOI's side at the finest.
ROAD_LEVELS = 6
_BESIDE = ((1, 0), (-1, 0), (0, 1), (0, -1))


def _side(z: str) -> str:
    return f"cast(power(2, {z}) as bigint)"


def _cell(v: str, origin: str, span: float) -> str:
    return f"cast(greatest(0, least({_side('z')} - 1, floor(({v} - {origin}) / {span}e0 * {_side('z')}))) as bigint)"


def _node(z: str, i: str, j: str) -> str:
    return f"cast(cast({z} as bigint) * 1000000 + ({i}) * 1000 + ({j}) as bigint)"


ROAD_NODE = [
    "aoi_id", f"{_node('z', 'i', 'j')} as node_id", f"ox + (i + 0.5e0) / {_side('z')} * 0.8e0 as lon",
    f"oy + (j + 0.5e0) / {_side('z')} * 0.6e0 as lat", "cast(z as int) as z", "i", "j",
]
#: Whole metres, so that sums along a path are exact: about the side of the finer cell.
ROAD_LENGTH = "cast(floor(80000e0 / power(2, z)) + (src * 31 + dst * 17) % 997 as double)"

_SOURCES = {
    "demand": (DEMAND, "customer join nation on c_nationkey = n_nationkey"),
    "candidates": (CANDIDATES, "supplier join nation on s_nationkey = n_nationkey"),
    "poi_a": (POI_A, "candidates"),
    "poi_b": (POI_B, "candidates"),
    "activity": (ACTIVITY, "events"),
    "boundaries": (BOUNDARY, "region"),
}
_NEEDS = {"poi_a": ["candidates"], "poi_b": ["candidates"], "boundary_edges": ["boundaries"]}


def _ring_rows() -> list[tuple[int, float, float, float, float]]:
    n = len(RING)
    return [(i, *RING[i], *RING[(i + 1) % n]) for i in range(n)]


class Views:
    """Spark side of the views, for one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def demand(self) -> DataFrame:
        j = self.table("customer").join(
            self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey")
        )
        return j.selectExpr(*DEMAND)

    def candidates(self) -> DataFrame:
        j = self.table("supplier").join(
            self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey")
        )
        return j.selectExpr(*CANDIDATES)

    def poi_a(self) -> DataFrame:
        return self.candidates().selectExpr(*POI_A)

    def poi_b(self) -> DataFrame:
        return self.candidates().selectExpr(*POI_B)

    def activity(self) -> DataFrame:
        return self.table("events").selectExpr(*ACTIVITY)

    def boundaries(self) -> DataFrame:
        return self.table("region").selectExpr(*BOUNDARY)

    def boundary_edges(self) -> DataFrame:
        ring = F.array(
            *[
                F.struct(*[F.lit(v).alias(n) for v, n in zip(r, ("seq", "a", "b", "c", "d"))])
                for r in _ring_rows()
            ]
        )
        e = self.boundaries().select("aoi_id", "ox", "oy", F.explode(ring).alias("e"))
        return e.select(
            "aoi_id",
            F.col("e.seq").alias("seq"),
            (F.col("ox") + F.col("e.a")).alias("x1"),
            (F.col("oy") + F.col("e.b")).alias("y1"),
            (F.col("ox") + F.col("e.c")).alias("x2"),
            (F.col("oy") + F.col("e.d")).alias("y2"),
        )

    def road_nodes(self) -> DataFrame:
        """Junctions: the cells of a quadtree over every AOI that hold a demand point, at all levels."""
        at = self.demand().select("aoi_id", "lon", "lat").join(self.boundaries().select("aoi_id", "ox", "oy"), "aoi_id")
        at = at.withColumn("z", F.explode(F.sequence(F.lit(0), F.lit(ROAD_LEVELS))))
        return at.selectExpr("aoi_id", "ox", "oy", "z", f"{_cell('lon', 'ox', 0.8)} as i", f"{_cell('lat', 'oy', 0.6)} as j").distinct().selectExpr(*ROAD_NODE)

    def road_edges(self) -> DataFrame:
        """Roads to the cells beside, some one-way or missing, and to the cell above."""
        n = self.road_nodes().withColumnRenamed("node_id", "src")
        beside = n.selectExpr("*", "explode(array(" + ", ".join(f"struct({a} as di, {b} as dj)" for a, b in _BESIDE) + ")) as s")
        beside = beside.selectExpr("aoi_id", "src", "z", f"{_node('z', 'i + s.di', 'j + s.dj')} as dst", f"i + s.di between 0 and {_side('z')} - 1 and j + s.dj between 0 and {_side('z')} - 1 as inside")
        beside = beside.where("inside and (src * 7 + dst * 3) % 11 <> 0").join(n.selectExpr("aoi_id", "src as dst"), ["aoi_id", "dst"])
        up = n.where("z > 0").selectExpr("aoi_id", "z", "src as low", f"{_node('z - 1', 'floor(i / 2)', 'floor(j / 2)')} as high")
        up = up.selectExpr("aoi_id", "z", "explode(array(struct(low as src, high as dst), struct(high as src, low as dst))) as e")
        both = beside.select("aoi_id", "z", "src", "dst").unionByName(up.select("aoi_id", "z", "e.src", "e.dst"))
        return both.selectExpr("aoi_id", "src", "dst", f"{ROAD_LENGTH} as length_m")


_EXTRA_SQL = {
    "boundary_edges": (
        "select aoi_id, cast(column0 as int) as seq, ox+column1 as x1, oy+column2 as y1,"
        " ox+column3 as x2, oy+column4 as y2 from boundaries, (values "
        + ", ".join("(%d, %s)" % (r[0], ", ".join(f"{v:.2f}e0" for v in r[1:])) for r in _ring_rows())
        + ") t(column0, column1, column2, column3, column4)"
    ),
    "road_nodes": (
        f"select {', '.join(ROAD_NODE)} from (select distinct aoi_id, ox, oy, z, {_cell('lon', 'ox', 0.8)} as i, {_cell('lat', 'oy', 0.6)} as j"
        f" from demand join boundaries using (aoi_id), (select unnest(range({ROAD_LEVELS} + 1)) as z))"
    ),
    "road_edges": (
        f"select aoi_id, src, dst, {ROAD_LENGTH} as length_m from ("
        f"select b.aoi_id, b.z, b.src, b.dst from (select aoi_id, z, node_id as src, {_node('z', 'i + di', 'j + dj')} as dst from road_nodes, (values "
        + ", ".join(f"({a}, {b})" for a, b in _BESIDE)
        + f") t(di, dj) where i + di between 0 and {_side('z')} - 1 and j + dj between 0 and {_side('z')} - 1) b"
        " join road_nodes n on n.aoi_id = b.aoi_id and n.node_id = b.dst where (b.src * 7 + b.dst * 3) % 11 <> 0"
        f" union all select aoi_id, z, node_id, {_node('z - 1', 'floor(i / 2)', 'floor(j / 2)')} from road_nodes where z > 0"
        f" union all select aoi_id, z, {_node('z - 1', 'floor(i / 2)', 'floor(j / 2)')}, node_id from road_nodes where z > 0)"
    ),
}
_NEEDS["road_nodes"] = ["demand", "boundaries"]
_NEEDS["road_edges"] = ["road_nodes"]


def oracle(body: str, *views: str, recursive: bool = False) -> str:
    """Prefix an oracle query with the CTEs of the views it uses."""
    seen: list[str] = []

    def visit(v: str) -> None:
        for d in _NEEDS.get(v, []):
            visit(d)
        if v not in seen:
            seen.append(v)

    for v in views:
        visit(v)
    ctes = []
    for v in seen:
        if v in _EXTRA_SQL:
            ctes.append(f"{v} as ({_EXTRA_SQL[v]})")
        else:
            cols, src = _SOURCES[v]
            ctes.append(f"{v} as (select {', '.join(cols)} from {src})")
    body = body.strip()
    head = "with recursive " if recursive else "with "
    if body.lower().startswith("with "):
        return head + ",\n".join(ctes + [body[5:]]) if ctes else head + body[5:]
    return (head + ",\n".join(ctes) + "\n" + body) if ctes else body
