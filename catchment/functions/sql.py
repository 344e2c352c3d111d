"""Functions of this library by name in SQL text.

Distances, units and name tests are SQL functions: Spark puts their expressions in place,
so they run in generated code like any column.  ``wkb_to_edges`` is a table function for
lateral joins.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession, functions as F

from ..sources.wkb import geometry_edges
from .geo import EARTH_RADIUS_M
from .units import UNIT_METRES

_FACTOR = "element_at(map(" + ", ".join(f"'{u}', {m}D" for u, m in UNIT_METRES.items()) + "), replace(lower(trim(unit)), ' ', ''))"
_CHORD = (
    "sqrt(power(sin((radians(lat2) - radians(lat1)) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * power(sin((radians(lon2) - radians(lon1)) / 2), 2))"
)
_TOKENS = "array_distinct(regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+', 0))"
_SAME = "size({a}) = 0 or size({b}) = 0 or 2 * size(array_intersect({a}, {b})) >= size(array_union({a}, {b}))".format(a=_TOKENS.format("a"), b=_TOKENS.format("b"))

#: name -> (parameters, return type, expression)
FUNCTIONS = {
    "haversine_m": ("lon1 double, lat1 double, lon2 double, lat2 double", "double", f"asin(case when {_CHORD} > 1 then 1D else {_CHORD} end) * {2 * EARTH_RADIUS_M}D"),
    "to_metres": ("value double, unit string", "double", f"case when unit is null then value else value * {_FACTOR} end"),
    "from_metres": ("value double, unit string", "double", f"coalesce(value / {_FACTOR}, value)"),
    "name_similar": ("a string, b string", "boolean", _SAME),
}


class WkbToEdges:
    """Edges of one geometry; null gives none."""

    def eval(self, wkb: bytes) -> Iterator[tuple]:
        if wkb is not None:
            yield from geometry_edges(wkb)


def register(spark: SparkSession) -> None:
    """Make all functions known to the session, in place of earlier ones of these names."""
    for name, (params, kind, body) in FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {name}({params}) returns {kind} return {body}")
    # a lateral join calls it once a row, and an Arrow batch for each row costs far more than the row
    edges = F.udtf(WkbToEdges, returnType="ring_no int, seq int, x1 double, y1 double, x2 double, y2 double", useArrow=False)
    spark.udtf.register("wkb_to_edges", edges)
