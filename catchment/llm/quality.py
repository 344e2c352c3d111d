"""Document quality from text statistics by gradient-boosted trees."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .gbt import Forest, fit

_CLASSES = {
    "lower": range(97, 123), "upper": range(65, 91), "digit": range(48, 58), "blank": (32, 9), "line": (10,), "stop": b".?",
    "comma": b",;:", "bang": b"!", "bar": b"|", "sign": b"#$%&*+=<>~^_@\\/", "quote": b"'\"`", "bracket": b"()[]{}", "dash": b"-",
    "high": range(128, 256), "control": [c for c in range(32) if c not in (9, 10, 13)],
}
NAMES = (
    "bytes", "words", "word_length", "distinct_words", "top_word", "repeats", "lines", "line_length", "distinct_lines", "top_line",
    "packed", "entropy", "links", *_CLASSES,
)
_MASK = np.array([[b in set(c) for c in _CLASSES.values()] for b in range(256)], np.float64)


def statistics(text: str | None) -> list[float]:
    """Statistics of a whole text, in the order of ``NAMES``; all zero for null and empty ones."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return [0.0] * len(NAMES)
    n = len(raw)
    held = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words, lines = raw.split(), raw.split(b"\n")
    count, line_count = Counter(words), Counter(lines)
    w = max(len(words), 1)
    share = held[held > 0] / n
    return [
        np.log1p(n), np.log1p(len(words)), sum(map(len, words)) / w, len(count) / w, max(count.values(), default=0) / w,
        sum(map(eq, words, words[1:])) / w, np.log1p(len(lines)), np.log1p(n / len(lines)), len(line_count) / len(lines),
        max(line_count.values()) / len(lines), len(zlib.compress(raw, 1)) / n, float(-(share * np.log2(share)).sum()),
        (raw.count(b"://") + raw.count(b"www.")) / w, *(held @ _MASK / n),
    ]


def _stat_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [statistics(t) for t in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), b.column(1)], ["x", "label"])


def learn_quality(labelled: DataFrame, **options: float) -> Forest:
    """Trees from (text, label) rows, a bounded sample: only its statistics come to the driver."""
    sample = labelled.select("text", F.col("label").cast("int").alias("label")).where("label is not null")
    rows = sample.mapInArrow(_stat_rows, "x array<double>, label int").orderBy("x", "label").collect()
    x = np.array([r["x"] for r in rows], float).reshape(-1, len(NAMES))
    return fit(x, np.array([r["label"] for r in rows], float), **options)


def score_quality(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row, over its whole text; higher: label 1 is likelier.

    Null and empty texts have all statistics zero and get the score of those.  Repeated
    rows: a row each.  Empty table: no rows.  Other columns are ignored.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([statistics(t) for t in b.column(1).to_pylist()], float).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shipped.value.predict(x))], ["doc_id", "score"])

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return d.mapInArrow(run, "doc_id long, score double")
