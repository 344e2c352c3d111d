"""The table of registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..fixtures import Views, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

HAV = (
    "floor(asin(least(1e0, sqrt("
    "sin((radians({b}.lat)-radians({a}.lat))/2e0)*sin((radians({b}.lat)-radians({a}.lat))/2e0)"
    "+cos(radians({a}.lat))*cos(radians({b}.lat))"
    "*(sin((radians({b}.lon)-radians({a}.lon))/2e0)*sin((radians({b}.lon)-radians({a}.lon))/2e0)))))"
    "*(2e0*6371008.8e0)*1000e0+0.5e0)/1000e0"
)


def hav(a: str, b: str) -> str:
    return HAV.format(a=a, b=b)


# nearest candidate of every demand point, as a CTE body
NEAREST_SQL = (
    "select d.aoi_id, d.demand_id, d.lon, d.lat, d.weight, min({h}) as dist_m, "
    "arg_min(c.site_id, ({h}, c.site_id)) as site_id "
    "from demand d join candidates c using (aoi_id) group by all"
).format(h=hav("d", "c"))


def query(name: str, body: str | None = None, views: tuple[str, ...] = (), recursive: bool = False):
    """Register a function of Views under ``name`` with its oracle body."""

    def wrap(fn: Callable[[Views], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Views(spark, sf_dir))
        if body is not None:
            ORACLES[name] = oracle(body, *views, recursive=recursive)
        return fn

    return wrap
