"""Names, labels and attribute picks as columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def normalise_name(c: Column) -> Column:
    """Lower case, every other character run to one underscore, none at the ends."""
    n = F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "_")
    return F.regexp_replace(n, "^_+|_+$", "")


def slug(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), "[ ,]+", "_")


def year_from_name(c: Column) -> Column:
    y = F.regexp_extract(c, "((?:19|20)[0-9]{2})", 1)
    return F.coalesce(F.try_to_number(y, F.lit("9999")).cast("int"), F.lit(0))


def name_tokens(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1)))


def name_similar(a: Column, b: Column) -> Column:
    """Token Jaccard of at least one half; a missing or wordless name agrees with all."""
    ta, tb = name_tokens(F.coalesce(a, F.lit(""))), name_tokens(F.coalesce(b, F.lit("")))
    inter = F.size(F.array_intersect(ta, tb))
    union = F.size(F.array_union(ta, tb))
    return (F.size(ta) == 0) | (F.size(tb) == 0) | (inter * 2 >= union)


def first_text(cols: Sequence[Column]) -> Column:
    return F.coalesce(*[F.nullif(F.trim(c.cast("string")), F.lit("")) for c in cols])


def first_numeric(cols: Sequence[Column]) -> Column:
    def num(c: Column) -> Column:
        n = c.try_cast("double")
        return F.when(~F.isnan(n), n)

    return F.coalesce(*[num(c) for c in cols])


def label_from_address(specific: Sequence[Column], area: Sequence[Column]) -> Column:
    """"specific, area" from the first filled field of each; one part if they agree."""
    def filled(cols):
        return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])

    s, a = filled(specific), filled(area)
    return F.nullif(F.concat_ws(", ", s, F.when(s.isNull() | (s != a), a)), F.lit(""))


# Prominence rank of a place kind; others rank 30.
KIND_RANK = {
    "country": 4, "state": 8, "region": 8, "admin_area": 10, "county": 12, "city": 16,
    "town": 18, "village": 20, "suburb": 22, "neighbourhood": 25,
}


def place_kind(key: Column, value: Column) -> Column:
    k, v = F.nullif(key, F.lit("")), F.nullif(value, F.lit(""))
    admin = (F.coalesce(k, F.lit("")) == "boundary") & (F.coalesce(v, F.lit("")) == "administrative")
    return F.when(admin, F.lit("admin_area")).otherwise(F.coalesce(v, k, F.lit("place")))


def place_rank(kind: Column) -> Column:
    table = F.create_map(*[F.lit(v) for kv in KIND_RANK.items() for v in kv])
    return F.coalesce(F.element_at(table, kind), F.lit(30))
