"""Toxicity from a weighted lexicon matched by an Aho-Corasick automaton.

Texts are folded first: lower case, look-alike letters of other scripts and digits or
signs that stand for letters.  An entry matches at the start of a word; matches inside
an exception phrase do not count.  The weights of a text's matches, their strongest and
their sum normalised by length go through a logistic curve.

Entries, weights and the curve are learned from a bounded sample of labelled texts:
an entry is a stem (or whole word) that toxic texts hold far more often than others.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .memory import tidy

# Letters that look like Latin ones, and signs used in their place.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y",
    "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ɡ": "g", "ո": "n", "α": "a", "β": "b", "ε": "e", "ι": "i",
    "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "l", "ø": "o",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
INVISIBLE = "­​‌‍⁠﻿"
#: Phrases in which an entry means no harm.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "idiot proof", "pathetic fallacy", "pond scum", "sore loser award")

_FULL_WIDTH = {c: unicodedata.normalize("NFKC", chr(c)).lower() for c in range(0xFF01, 0xFF5F)}
_FOLD = {ord(k): v for k, v in (HOMOGLYPHS | SUBSTITUTES).items()} | {ord(c): None for c in INVISIBLE} | {
    c: SUBSTITUTES.get(v, v) for c, v in _FULL_WIDTH.items()
}
_WORD = re.compile(r"[^\W\d_]+")
STEMS = range(4, 13)


def fold(text: str) -> str:
    return text.lower().translate(_FOLD)


def stems(text: str | None) -> set[str]:
    """Distinct word starts of ``STEMS`` lengths, and whole shorter words, of a folded text."""
    out: set[str] = set()
    for w in set(_WORD.findall(fold(text or ""))):
        out.update(w[:k] for k in STEMS if k <= len(w))
    return out


@dataclass(frozen=True)
class Lexicon:
    weights: tuple[tuple[str, float], ...]
    exceptions: tuple[str, ...]
    curve: tuple[float, ...] = (-2.0, 0.0, 0.0, 0.0)


@lru_cache(maxsize=4)
def _automaton(lexicon: Lexicon) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for word, weight in lexicon.weights:
        a.add_word(word, (len(word), weight))
    for phrase in lexicon.exceptions:
        a.add_word(fold(phrase), (len(fold(phrase)), None))
    a.make_automaton()
    return a


def matches(text: str | None, lexicon: Lexicon) -> list[tuple[int, int, float]]:
    """(start, end, weight) of the entries that count, in the folded text."""
    if not text or not len(lexicon.weights) + len(lexicon.exceptions):
        return []
    t, hits, safe = fold(text), [], []
    for end, (n, weight) in _automaton(lexicon).iter(t):
        start = end + 1 - n
        if start and t[start - 1].isalpha():
            continue
        if weight is not None:
            hits.append((start, end + 1, weight))
        elif end + 1 == len(t) or not t[end + 1].isalpha():
            safe.append((start, end + 1))
    return [h for h in hits if not any(a <= h[0] and h[1] <= b for a, b in safe)] if safe else hits


def features(text: str | None, lexicon: Lexicon) -> tuple[float, float, float]:
    """Strongest weight, log of the sum, and log of the sum for each hundred words (a word is a run between spaces)."""
    found = matches(text, lexicon)
    if not found:
        return 0.0, 0.0, 0.0
    total = sum(w for _, _, w in found)
    n = text.count(" ") + text.count("\n") + 1
    return max(w for _, _, w in found), math.log1p(total), math.log1p(100 * total / n)


def score_texts(texts: list[str | None], lexicon: Lexicon) -> np.ndarray:
    x = np.array([features(t, lexicon) for t in texts], float).reshape(-1, 3)
    z = lexicon.curve[0] + x @ np.array(lexicon.curve[1:])
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@tidy("toxicity", _automaton.cache_clear)
def _count_stems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document counts of every stem, summed over the task's part of the sample."""
    bad, good, seen = Counter(), Counter(), set()
    for b in batches:
        for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if text not in seen:  # exact copies count once
                seen.add(text)
                (bad if label else good).update(stems(text))
    keys = list(bad | good)
    yield pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.string()), pa.array([bad[k] for k in keys], pa.int64()), pa.array([good[k] for k in keys], pa.int64())],
        ["stem", "bad", "good"],
    )


def _pick(rows: list[tuple[str, int, int]], n_bad: int, n_good: int) -> tuple[tuple[str, float], ...]:
    """Of nested stems the one that tells most; of equal ones the longest."""
    weigh = lambda b, g: math.log((b + 0.5) / (n_bad + 1)) - math.log((g + 0.5) / (n_good + 1))
    ranked = sorted(((weigh(b, g), len(s), s) for s, b, g in rows), reverse=True)
    chosen: dict[str, float] = {}
    begun: set[str] = set()
    for weight, _, s in ranked:
        if s in begun or any(s[:k] in chosen for k in range(1, len(s))):
            continue
        chosen[s] = weight
        begun.update(s[:k] for k in range(1, len(s)))
    return tuple(sorted(chosen.items()))


def _fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Logistic regression by Newton steps; a slight ridge keeps it finite on separable data."""
    a = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(a.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        ridge = np.diag([1e-3, *[1.0] * x.shape[1]])
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + ridge, a.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def learn_lexicon(labelled: DataFrame, exceptions: tuple[str, ...] = EXCEPTIONS, min_docs: int = 6, min_precision: float = 0.9) -> Lexicon:
    """Lexicon from (text, label) rows, a bounded sample; its candidate stems come to the driver.

    Null texts tell nothing; copies of a text in a task count once.  No rows: an empty lexicon.
    A candidate stands in ``min_docs`` different toxic texts or more, and in toxic ones only,
    up to a share of 1 - ``min_precision``.
    """
    sample = labelled.where("text is not null").select("text", F.col("label").cast("int").alias("label")).cache()
    n = {r["label"] > 0: r["count"] for r in sample.groupBy("label").count().collect()}
    n_bad, n_good = n.get(True, 0), n.get(False, 0)
    counts = sample.repartition("text").mapInArrow(_count_stems, "stem string, bad long, good long")
    sums = counts.groupBy("stem").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    share = max(n_bad, 1) / max(n_bad + n_good, 1)
    precise = sums.where((F.col("bad") >= min_docs) & (F.col("bad") >= max(min_precision, share) * (F.col("bad") + F.col("good"))))
    rows = precise.orderBy("stem").collect()
    lexicon = Lexicon(_pick([tuple(r) for r in rows], n_bad, n_good), exceptions)
    scored = sample.mapInArrow(_feature_rows(lexicon), "a double, b double, c double, label int").collect()
    sample.unpersist()
    data = np.array([tuple(r) for r in scored], float).reshape(-1, 4)
    return Lexicon(lexicon.weights, exceptions, _fit_curve(data[:, :3], data[:, 3])) if len(data) else lexicon


def _feature_rows(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t, lexicon) for t in b.column(0).to_pylist()], float).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*(pa.array(x[:, k]) for k in range(3)), b.column(1)], ["a", "b", "c", "label"])

    return run


def score_toxicity(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row, over its whole text; 0 to 1, higher is more toxic.

    Null, empty and matchless texts get the curve's lowest value.  Repeated rows: a row
    each.  Empty table: no rows.  Other columns are ignored.
    """

    @tidy("toxicity", _automaton.cache_clear)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score_texts(b.column(1).to_pylist(), lexicon))], ["doc_id", "score"])

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return d.mapInArrow(run, "doc_id long, score double")


def reject_toxic(docs: DataFrame, lexicon: Lexicon, score_from: float, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that score ``score_from`` or more; all columns stay as they are."""
    at = docs.columns.index(text_col)

    @tidy("toxicity", _automaton.cache_clear)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(score_texts(b.column(at).to_pylist(), lexicon) < score_from))

    return docs.mapInArrow(run, docs.schema)
