"""URL filter: host rules, and gradient-boosted trees on lexical features for the rest."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .gbt import Forest, fit
from .line_dedup import LOWER, UPPER

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Suffix statistics are learned for these parts of a URL.
SUFFIXES = ("top_label", "domain", "extension")
_PARTS = re.compile(r"^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$", re.DOTALL)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty if there is no ``://``."""
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def match_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, both null if none does.

    A rule ``host/path`` fits its host and all subdomains where the path starts with
    ``/path``.  ``rules`` are (verdict, rule) pairs, a list short enough to be part of the plan.
    """
    rule = verdict = F.lit(None).cast("string")
    for does, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the longest is tested first
        h, _, p = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, does).otherwise(verdict)
    return rule, verdict


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def lexical(url: str | None) -> tuple[list[float], dict[str, str]]:
    """Lexical features of a URL, and the suffixes whose statistics count."""
    m = _PARTS.match(url or "")
    host, path, query, fragment = ((g or "") for g in m.groups()) if m else ("", url or "", "", "")
    host = host.lower()
    labels, parts = host.split("."), [p for p in path.split("/") if p]
    whole = (url or "").lower()
    n = max(len(whole), 1)
    last = parts[-1] if parts else ""
    x = [
        len(whole), len(host), len(path), len(query), len(fragment), len(labels) if host else 0, len(parts), max(map(len, labels)),
        max(map(len, parts), default=0), sum(c.isdigit() for c in whole) / n, sum(c.isdigit() for c in host) / max(len(host), 1),
        sum(not c.isalnum() for c in whole) / n, host.count("-"), path.count("-") + path.count("_"), whole.count("%"),
        query.count("=") + query.count("&"), len([p for p in query[1:].split("&") if p]), float(whole.startswith("https:")), float(":" in host),
        float(labels[0] in ("www", "m")), float(all(p.isdigit() for p in labels) and bool(host)), _entropy(host), _entropy(whole),
        sum(c in "aeiou" for c in host) / max(sum(c.isalpha() for c in host), 1), float(path.endswith("/")), float("." in last),
    ]
    return x, {"top_label": labels[-1], "domain": ".".join(labels[-2:]), "extension": last.rpartition(".")[2] if "." in last else ""}


@dataclass(frozen=True)
class UrlModel:
    prior: float
    rates: dict[str, dict[str, float]]
    forest: Forest

    def features(self, urls: list[str | None]) -> np.ndarray:
        rows = []
        for u in urls:
            x, suffix = lexical(u)
            rows.append([*x, *(self.rates[k].get(suffix[k], self.prior) for k in SUFFIXES)])
        return np.array(rows, float) if rows else np.zeros((0, 1))

    def score(self, urls: list[str | None]) -> np.ndarray:
        return self.forest.predict(self.features(urls)) if urls else np.empty(0)


def learn_urls(labelled: DataFrame, min_count: int = 5, weight: float = 20.0, **options: float) -> UrlModel:
    """Model from (url, label) rows, a bounded sample that comes to the driver; label 1 is to be allowed.

    The rate of a suffix is drawn to the prior as by ``weight`` rows; suffixes with
    fewer than ``min_count`` rows have none.
    """
    rows = labelled.select("url", F.col("label").cast("int").alias("label")).where("url is not null and label is not null")
    rows = rows.orderBy("url", "label").collect()
    y = np.array([r["label"] for r in rows], float)
    prior = float((y.sum() + 1) / (len(y) + 2))
    rates: dict[str, dict[str, float]] = {}
    for k in SUFFIXES:
        held: dict[str, list[float]] = {}
        for r in rows:
            held.setdefault(lexical(r["url"])[1][k], []).append(r["label"])
        rates[k] = {s: (sum(v) + weight * prior) / (len(v) + weight) for s, v in held.items() if len(v) >= min_count}
    model = UrlModel(prior, rates, Forest(0, 0.0, *(np.zeros((0, 1)),) * 3))
    return UrlModel(prior, rates, fit(model.features([r["url"] for r in rows]), y, **options))


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], most_labelled: int = 20_000, allow_from: float = 0.5, model: UrlModel | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """A verdict on every URL: the rule's where one fits, else the trees'.

    Without ``model`` the URLs that rules decide are the labelled ones: trees are learned
    from ``most_labelled`` of them at most, those with the least hash.  Returns page_id,
    host, path, rule, verdict (allow or block) and score (probability of allow).

    Null URLs and such without ``://``: host and path empty, no rule, judged on what
    there is.  Repeated rows: a row each.  Empty table: no rows.  Other columns are ignored.
    """
    from .sampling import bounded

    url = F.col(url_col).cast("string")
    d = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"))
    d = d.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rule, verdict = match_rule(F.col("host"), F.col("path"), rules)
    d = d.withColumns({"rule": rule, "ruled": verdict})
    if model is None:
        told = d.where("ruled is not null").select("url", (F.col("ruled") == "allow").cast("int").alias("label")).distinct()
        model = learn_urls(bounded(told, most_labelled, "url"))
    shipped = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = pa.array(shipped.value.score(b.column(1).to_pylist()), pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, score], [*b.schema.names, "score"])

    out = d.mapInArrow(run, "page_id long, url string, host string, path string, rule string, ruled string, score double")
    judged = F.coalesce("ruled", F.when(F.col("score") >= allow_from, "allow").otherwise("block"))
    return out.select("page_id", "host", "path", "rule", judged.alias("verdict"), "score")
