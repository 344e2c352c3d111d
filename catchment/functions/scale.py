"""Geographic scale of a place: name rules, lookups, plausible areas."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Per scale, admin level, box buffer in degrees, plausible box area in square degrees.
SCALES = {
    "country": (3, 15.0, 10.0, float("inf")),
    "region": (5, 5.0, 0.5, 50.0),
    "city": (7, 2.0, 0.01, 5.0),
    "neighborhood": (9, 0.5, 0.0001, 0.5),
}
REGION_WORDS = (
    "province", "state", "region", "department", "governorate", "oblast", "prefecture",
    "canton", "lander", "länder",
)
NEIGHBORHOOD_WORDS = (
    "district", "ward", "neighbourhood", "neighborhood", "barrio", "commune", "arrondissement",
    "upazila", "quartier", "sector", "colonia", "municipio",
)


def n_points_from_area(area_km2: Column, least: int = 50, most: int = 2000) -> Column:
    n = F.floor(F.sqrt(F.greatest(area_km2, F.lit(0.0))) * 8).cast("bigint")
    return F.greatest(F.lit(least).cast("bigint"), F.least(F.lit(most).cast("bigint"), n))


def scale_from_location(loc: Column) -> Column:
    t = F.lower(F.trim(loc))
    bare = (t != "") & ~t.contains(",") & ~t.contains(" ")
    return (
        F.when(t.rlike("|".join(REGION_WORDS)), "region")
        .when(t.rlike("|".join(NEIGHBORHOOD_WORDS)), "neighborhood")
        .when(bare, "country")
        .otherwise("city")
    )


def _lookup(scale: Column, i: int, default) -> Column:
    table = F.create_map(*[F.lit(v) for k, row in SCALES.items() for v in (k, row[i])])
    return F.coalesce(F.element_at(table, scale), F.lit(default))


def admin_level(scale: Column) -> Column:
    return _lookup(scale, 0, 7)


def bbox_buffer(scale: Column) -> Column:
    return _lookup(scale, 1, 2.0)


def area_range(scale: Column) -> tuple[Column, Column]:
    return _lookup(scale, 2, 0.0), _lookup(scale, 3, float("inf"))
