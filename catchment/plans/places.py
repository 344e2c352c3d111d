"""Choosing among places, divisions, countries and provider tiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.dedup import best_per_key, first_tier
from ..operators.nearest import nearest_site

# Admin level of a division subtype; preferred subtypes per scale.
SUBTYPE_LEVEL = {"country": 2, "region": 4, "county": 6, "localadmin": 7, "locality": 8, "neighborhood": 10}
PREFERRED_SUBTYPES = {
    "country": ("country",),
    "region": ("region", "county", "localadmin"),
    "city": ("locality", "localadmin", "county", "region"),
    "neighborhood": ("neighborhood", "locality", "localadmin"),
}


def _position(c: Column, names) -> Column:
    out = F.lit(len(names))
    for i, n in reversed(list(enumerate(names))):
        out = F.when(c == n, F.lit(i)).otherwise(out)
    return out


def best_division(matches: DataFrame, areas: DataFrame, keys: Sequence[str], scale: str = "city", admin_level: int | None = None) -> DataFrame:
    """(keys, id, subtype): the best-ranked division that has an area.

    ``matches`` has (keys, id, name, subtype, wanted).  Exact name hits push
    substring hits out.
    """
    k = list(keys)
    exact = (F.lower("name") == F.lower(F.trim("wanted"))).cast("int")
    m = matches.withColumn("_exact", exact)
    top = m.groupBy(*k).agg(F.max("_exact").alias("_any"))
    m = m.join(top, k).where(F.col("_exact") == F.col("_any"))
    if admin_level is not None:
        level = F.create_map(*[F.lit(v) for kv in SUBTYPE_LEVEL.items() for v in kv])
        order = F.abs(F.coalesce(F.element_at(level, F.col("subtype")), F.lit(8)) - admin_level)
    else:
        order = _position(F.col("subtype"), PREFERRED_SUBTYPES[scale])
    usable = m.withColumn("_o", order).join(areas.select("id"), "id", "left_semi")
    return best_per_key(usable, k, [F.asc("_o"), F.asc("id")], 1, rank="_r").select(*k, "id", "subtype")


def tier_fallback(tiers: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Rows of the first provider that has any, per key; tiers are numbered from 1."""
    rows = None
    for i, t in enumerate(tiers, 1):
        t = t.withColumn("tier", F.lit(i))
        rows = t if rows is None else rows.unionByName(t, allowMissingColumns=True)
    return first_tier(rows, keys)


# Short and old country names with their ISO codes.
COUNTRY_ALIASES = {
    "drc": "COD", "dr congo": "COD", "dr-congo": "COD", "democratic republic of congo": "COD",
    "democratic republic of the congo": "COD", "congo kinshasa": "COD", "congo-kinshasa": "COD",
    "congo brazzaville": "COG", "congo-brazzaville": "COG", "republic of congo": "COG", "republic of the congo": "COG",
    "uk": "GBR", "u.k.": "GBR", "britain": "GBR", "great britain": "GBR", "england": "GBR", "scotland": "GBR",
    "wales": "GBR", "northern ireland": "GBR", "usa": "USA", "u.s.": "USA", "u.s.a.": "USA", "us": "USA",
    "united states": "USA", "america": "USA", "russia": "RUS", "south korea": "KOR", "korea south": "KOR",
    "republic of korea": "KOR", "north korea": "PRK", "korea north": "PRK", "dprk": "PRK", "vietnam": "VNM",
    "viet nam": "VNM", "iran": "IRN", "syria": "SYR", "laos": "LAO", "taiwan": "TWN", "burma": "MMR", "myanmar": "MMR",
    "ivory coast": "CIV", "cote d'ivoire": "CIV", "cote divoire": "CIV", "czech republic": "CZE", "czechia": "CZE",
    "macedonia": "MKD", "north macedonia": "MKD", "palestine": "PSE", "west bank": "PSE", "gaza": "PSE",
    "east timor": "TLS", "timor leste": "TLS", "cape verde": "CPV", "swaziland": "SWZ", "eswatini": "SWZ",
    "holy see": "VAT", "vatican": "VAT", "bolivia": "BOL", "venezuela": "VEN", "tanzania": "TZA", "moldova": "MDA",
    "brunei": "BRN", "micronesia": "FSM",
}


def resolve_country(places: DataFrame, countries: DataFrame, gazetteer: DataFrame, key: str) -> DataFrame:
    """(key, iso3, via) from code, name, the last parts of the query, or the centroid.

    ``places`` has (key, code, country, query, lon, lat); ``countries`` (iso2,
    iso3, name); ``gazetteer`` (qlon, qlat, iso3) at quarter degrees.
    """
    parts = F.filter(F.transform(F.split(F.coalesce("query", F.lit("")), ","), lambda s: F.trim(s)), lambda s: s != "")
    last = F.reverse(F.slice(F.reverse(parts), 1, 3))
    tries = F.concat(F.array("code", "country"), F.reverse(last))
    t = places.select(key, F.posexplode(tries).alias("pos", "raw")).where("raw is not null and trim(raw) <> ''")
    plain = F.trim(F.regexp_replace(F.lower(F.trim("raw")), r"\.", ""))
    alias = F.create_map(*[F.lit(v) for kv in COUNTRY_ALIASES.items() for v in kv])
    t = t.withColumn("_alias", F.element_at(alias, plain)).withColumn("_low", F.lower(F.trim("raw")))
    names = F.explode(F.array(F.lower("iso2"), F.lower("iso3"), F.lower("name")))
    look = countries.select(names.alias("_low"), F.col("iso3").alias("_code")).groupBy("_low").agg(F.min("_code").alias("_code"))
    t = t.join(look, "_low", "left").withColumn("iso3", F.coalesce("_alias", "_code")).where("iso3 is not null")
    hit = t.groupBy(key).agg(F.min(F.struct("pos", "iso3")).alias("m")).select(key, F.col("m.iso3").alias("iso3"), F.when(F.col("m.pos") == 0, "code").when(F.col("m.pos") == 1, "name").otherwise("query").alias("via"))
    rest = places.join(hit, key, "left_anti").select(key, (F.round(F.col("lon") * 4.0) / 4.0).alias("qlon"), (F.round(F.col("lat") * 4.0) / 4.0).alias("qlat"))
    geo = rest.join(gazetteer, ["qlon", "qlat"], "left").select(key, "iso3", F.when(F.col("iso3").isNotNull(), "centroid").alias("via"))
    return hit.unionByName(geo)


def label_facilities(sites: DataFrame, gazetteer: DataFrame, keys: Sequence[str] = ("aoi_id",)) -> DataFrame:
    """(keys, site_id, place): nearest gazetteer label of every site."""
    k = list(keys)
    s = sites.select(*k, "site_id", F.round("lon", 5).alias("lon"), F.round("lat", 5).alias("lat"))
    near = nearest_site(s, gazetteer, k, point_id="site_id", site_id="place_id", id_name="place_id", dist_name="_d")
    lab = near.join(gazetteer.select(*k, "place_id", "label"), [*k, "place_id"], "left")
    return lab.select(*k, "site_id", F.col("label").alias("place"))


def attach_points(assignments: DataFrame, demand: DataFrame, sites: DataFrame, keys: Sequence[str] = ("aoi_id",)) -> DataFrame:
    """Assignments with the coordinates of both ends."""
    k = list(keys)
    d = demand.select(*k, "demand_id", F.col("lon").alias("dx"), F.col("lat").alias("dy"), "weight")
    s = sites.select(*k, "site_id", F.col("lon").alias("sx"), F.col("lat").alias("sy"))
    return assignments.select(*k, "demand_id", "site_id").join(d, [*k, "demand_id"]).join(s, [*k, "site_id"])
