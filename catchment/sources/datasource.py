"""Place providers by name, each a table that Spark reads, in one layout.

A provider names a Spark reader format and maps its columns to the layout; files,
folders, remote paths, pruning and pushed filters stay with Spark.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

#: The layout: column and type.
LAYOUT = {"place_id": "bigint", "name": "string", "lon": "double", "lat": "double", "weight": "double"}


@dataclass(frozen=True)
class Provider:
    """``columns`` maps layout columns to SQL expressions over the provider's own; others are null."""

    name: str
    description: str
    categories: tuple[str, ...]
    columns: Mapping[str, str]
    format: str = "parquet"
    options: Mapping[str, str] = field(default_factory=dict)
    schema: str | None = None

    def faults(self, path: str | None, box: tuple[float, float, float, float] | None = None) -> list[str]:
        """What is wrong with a request; empty when it can be read."""
        out = [] if path else ["path is required"]
        out += [f"unknown column {c}" for c in self.columns if c not in LAYOUT]
        out += [f"column {c} is required" for c in ("place_id", "lon", "lat") if c not in self.columns]
        if box is not None and not (box[0] <= box[2] and box[1] <= box[3]):
            out.append("box must be west, south, east, north")
        return out

    def fetch(self, spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None) -> DataFrame:
        """(provider, the layout) of the places, those in ``box`` only if one is given.

        Null coordinates lie in no box.  Where a coordinate is a plain column, the box
        reaches the scan.
        """
        wrong = self.faults(path, box)
        if wrong:
            raise ValueError(f"{self.name}: {'; '.join(wrong)}")
        reader = spark.read.format(self.format).options(**self.options)
        rows = (reader.schema(self.schema) if self.schema else reader).load(path)
        out = rows.select(F.lit(self.name).alias("provider"), *[F.expr(self.columns.get(c, "null")).cast(t).alias(c) for c, t in LAYOUT.items()])
        if box is None:
            return out
        w, s, e, n = box
        return out.where(F.col("lon").between(w, e) & F.col("lat").between(s, n))


class Registry:
    """Providers by name; a later one of the same name takes its place."""

    def __init__(self, *providers: Provider):
        self._by_name = {p.name: p for p in providers}

    def register(self, provider: Provider) -> None:
        self._by_name[provider.name] = provider

    def get(self, name: str) -> Provider | None:
        return self._by_name.get(name)

    def available(self, spark: SparkSession, category: str | None = None) -> DataFrame:
        """(name, description, categories), by name."""
        rows = [(p.name, p.description, list(p.categories)) for _, p in sorted(self._by_name.items()) if category is None or category in p.categories]
        return spark.createDataFrame(rows, "name string, description string, categories array<string>")

    def fetch_all(self, spark: SparkSession, paths: Mapping[str, str], box=None) -> DataFrame:
        """The places of several providers, ``paths`` by name, in one table; an unknown name is an error."""
        unknown = sorted(set(paths) - set(self._by_name))
        if unknown or not paths:
            raise ValueError(f"unknown providers: {', '.join(unknown)}" if unknown else "no provider asked for")
        out = None
        for name in sorted(paths):
            one = self._by_name[name].fetch(spark, paths[name], box)
            out = one if out is None else out.unionByName(one)
        return out
