"""Length units and number formats as columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Metres per unit name.
UNIT_METRES = {
    "m": 1.0, "meter": 1.0, "meters": 1.0,
    "km": 1000.0, "kilometer": 1000.0, "kilometers": 1000.0,
    "mi": 1609.344, "mile": 1609.344, "miles": 1609.344,
    "ft": 0.3048, "foot": 0.3048, "feet": 0.3048,
    "yd": 0.9144, "yard": 0.9144, "yards": 0.9144,
    "nm": 1852.0, "nmi": 1852.0, "nauticalmile": 1852.0, "nauticalmiles": 1852.0,
}


def _factor(unit: Column) -> Column:
    table = F.create_map(*[F.lit(v) for kv in UNIT_METRES.items() for v in kv])
    return F.element_at(table, F.regexp_replace(F.lower(F.trim(unit)), " ", ""))


def to_metres(value: Column, unit: Column) -> Column:
    """Metres; null for an unknown unit, the value itself for no unit."""
    return F.when(unit.isNull(), value).otherwise(value * _factor(unit))


def from_metres(value: Column, unit: Column) -> Column:
    """Value in the unit; unknown units pass the metres through."""
    return F.coalesce(value / _factor(unit), value)


def format_metric(v: Column) -> Column:
    """1,234.5 from a thousand up; at most three decimals below."""
    small = F.rtrim(F.format_number(v, 3), F.lit("0"))
    small = F.rtrim(small, F.lit("."))
    return F.when(F.abs(v) >= 1000, F.format_number(v, 1)).otherwise(small)


def degradation_pct(base: Column, value: Column, maximise: Column) -> Column:
    """How much worse ``value`` is than ``base``, in percent of |base|."""
    gap = F.when(maximise, base - value).otherwise(value - base)
    return F.when(base != 0, gap / F.abs(base) * 100.0)
