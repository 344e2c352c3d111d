"""Importance resampling towards a target: hashed word runs weighed by how much more the target holds them.

Texts are cut to slices of bounded bytes inside a task.  The distinct words of a slice,
each between two delimiters, make an Aho-Corasick dictionary whose entries carry the CRC
and the length of the word; one scan of a text emits the entries of its words in order.
The CRC of a run of words is composed from the entries of adjacent words (a CRC after n
more bytes is a linear map of the CRC before), so no run is ever built as a string.  CRCs
modulo ``buckets`` are the features.

The features of a text are written once, as packed bucket numbers; counting and scoring
read those.  Counts come to the driver as ``buckets`` numbers, whatever the corpus.  Draws
are ranked by ranges of the score: every task numbers its own range, and the rows before
it are added, so no task sees all scores.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import materialize, release

BUCKETS = 10_000
#: Bytes of text that share a dictionary.
SLICE_BYTES = 4 << 20
#: Longer words go into the dictionary under a stand-in, so its size follows the number of words.
LONG_WORD = 64

# A-Z fall to a-z; ASCII signs that are neither letter nor digit part words.
_WORD_BYTES = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyz") | frozenset(range(128, 256))
_FOLD = bytes(c if c in _WORD_BYTES else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_LONG = re.compile(rb"[^ ]{%d,}" % (LONG_WORD + 1))


def words(text: str | None) -> bytes:
    """The text as bytes with every delimiter a blank."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD) if text else b""


@lru_cache(maxsize=1024)
def _shift(n: int) -> np.ndarray:
    """(4, 256): what the CRC of X adds to that of X and ``n`` more bytes, by its own four bytes (linear, so they are xored)."""
    zero = zlib.crc32(bytes(n))
    bits = np.array([zlib.crc32(bytes(n), 1 << i) ^ zero for i in range(32)], np.uint32)
    out = np.zeros((4, 256), np.uint32)
    for i in range(32):
        out[i // 8, (np.arange(256) >> i % 8 & 1).astype(bool)] ^= bits[i]
    return out


@lru_cache(maxsize=1)
def _short_shifts() -> np.ndarray:
    return np.stack([_shift(n) for n in range(LONG_WORD + 1)])


def follow(before: np.ndarray, after: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRCs of joined strings, from the CRCs of both halves and the byte lengths of the second ones."""
    short = _short_shifts()
    n = np.minimum(lengths, LONG_WORD)
    part = [before >> np.uint32(8 * k) & np.uint32(255) for k in range(4)]
    out = short[n, 0, part[0]] ^ short[n, 1, part[1]] ^ short[n, 2, part[2]] ^ short[n, 3, part[3]]
    for m in np.unique(lengths[lengths > LONG_WORD]):
        at, t = np.flatnonzero(lengths == m), _shift(int(m))
        out[at] = t[0, part[0][at]] ^ t[1, part[1][at]] ^ t[2, part[2][at]] ^ t[3, part[3][at]]
    return out ^ after


class Dictionary:
    """The distinct words of some texts in an automaton, with their CRCs and lengths."""

    def __init__(self, texts: list[bytes]) -> None:
        self._long: dict[bytes, bytes] = {}
        self.texts = [_LONG.sub(self._stand_in, t) for t in texts]
        told = {v: k for k, v in self._long.items()}
        keys = sorted(set(chain.from_iterable(t.split() for t in self.texts)))
        real = [told.get(k, k) for k in keys]
        self.crc = np.fromiter(map(zlib.crc32, real), np.uint32, len(real))
        self.length = np.fromiter(map(len, real), np.int64, len(real))
        self._machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, k in enumerate(keys):
            self._machine.add_word(f" {k.decode('latin-1')} ", i)
        if keys:
            self._machine.make_automaton()

    def _stand_in(self, m: re.Match[bytes]) -> bytes:
        # the byte 1 is a delimiter, so no folded word begins with it
        return self._long.setdefault(m[0], b"\x01%d" % len(self._long))

    def scan(self) -> tuple[np.ndarray, np.ndarray]:
        """(entries of all words of all texts in order, words of each text)."""
        counts = np.fromiter((len(t.split()) for t in self.texts), np.int64, len(self.texts))
        if not counts.sum():
            return np.empty(0, np.int64), counts
        found = chain.from_iterable(self._machine.iter(f" {t.decode('latin-1')} ") for t in self.texts)
        return np.fromiter(map(itemgetter(1), found), np.int64, int(counts.sum())), counts


def feature_buckets(texts: list[str | None], width: int = 2, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets of all runs of 1 to ``width`` words, text by text; features of each text; words of each text)."""
    book = Dictionary([words(t) for t in texts])
    entry, counts = book.scan()
    owner = np.repeat(np.arange(len(texts)), counts)
    crc, length = book.crc[entry], book.length[entry]
    at, run, owners, found = np.arange(len(entry)), crc, [], []
    for n in range(1, width + 1):
        owners.append(owner[at])
        found.append(run % np.uint32(buckets))
        if n < width:
            fits = at + n < len(entry)
            fits[fits] = owner[at[fits]] == owner[at[fits] + n]
            at, run = at[fits], run[fits]
            run = follow(run, np.full(len(at), zlib.crc32(b" "), np.uint32), np.ones(len(at), np.int64))
            run = follow(run, crc[at + n], length[at + n])
    owners = np.concatenate(owners)
    flat = np.concatenate(found)[np.argsort(owners, kind="stable")]
    return flat, np.bincount(owners, minlength=len(texts)), counts


def _kind(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def _slices(ids: list, texts: list[str | None]) -> Iterator[tuple[list, list[str | None]]]:
    """The rows in runs of about ``SLICE_BYTES`` of text; a longer text is a run of its own."""
    lo = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > SLICE_BYTES:
            yield ids[lo:i], texts[lo:i]
            lo = i
            size = 0
        size += n
    if lo < len(texts):
        yield ids[lo:], texts[lo:]


def _featurize(width: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, texts in _slices(b.column(0).to_pylist(), b.column(1).to_pylist()):
                flat, features, counts = feature_buckets(texts, width, buckets)
                ends = np.cumsum(features)
                flat = flat.astype(_kind(buckets))
                packed = [flat[e - n : e].tobytes() for n, e in zip(features, ends)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(counts), pa.array(features), pa.array(packed, pa.binary())], ["doc_id", "n_words", "n_features", "features"]
                )

    return run


def features_of(texts: DataFrame, width: int, buckets: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n_words, n_features, features): the bucket numbers of every whole text, packed."""
    d = texts.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return d.mapInArrow(_featurize(width, buckets), "doc_id long, n_words long, n_features long, features binary")


def bucket_counts(features: DataFrame, buckets: int) -> np.ndarray:
    """How often all texts hold each bucket; a task sums first, ``buckets`` rows come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for raw in b.column(0):
                total += np.bincount(np.frombuffer(raw.as_buffer(), _kind(buckets)), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in features.select("features").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(share in the target / share in the corpus)) of each bucket, every count raised by one."""
    n, s_all, t_all = len(corpus), float(corpus.sum()), float(target.sum())
    ratio = [(t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)) for s, t in zip(corpus.tolist(), target.tolist())]
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def noise(seed: int, doc_id: int) -> int:
    """Gumbel noise of a document, in thousandths, from the first 32 bits of sha256 of ``<seed>:<id>``."""
    h = int(hashlib.sha256(b"%d:%d" % (seed, doc_id)).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _weigh(gains: np.ndarray, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column("n_features").to_numpy()
            weight = np.zeros(len(n), np.int64)
            for i, raw in enumerate(b.column("features")):
                if n[i]:
                    weight[i] = int(gains[np.frombuffer(raw.as_buffer(), _kind(len(gains)))].sum()) // int(n[i])
            score = [None if d is None else w + noise(seed, d) for d, w in zip(b.column("doc_id").to_pylist(), weight.tolist())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "n_words", "n_features")), pa.array(weight), pa.array(score, pa.int64())], ["doc_id", "n_words", "n_features", "weight", "score"])

    return run


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, width: int = 2, buckets: int = BUCKETS, seed: int = 7,
    id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
) -> DataFrame:
    """Draw ``percent`` percent of the documents of ``least_words`` words or more, likelier ones closer to the target.

    Returns for every row doc_id, n_features, weight (floored mean gain of its features, 0
    without any), score (weight and Gumbel noise, so that the highest scores are a draw
    without replacement) and rank (1, 2, ... by falling score, then id; null if not drawn).

    Null or wordless text: 0 features, weight 0, not drawn.  Null id: score null, not drawn and
    not counted, though its words count.  Repeated rows: each counts and has a rank of its own.
    Empty table: no rows.  Empty target: gains come from the corpus alone.  Other columns are ignored.
    """
    held = materialize(features_of(docs, width, buckets, id_col, text_col), "features")
    aim = features_of(target.withColumn("_none", F.lit(None).cast("long")).select("_none", target_col), width, buckets, "_none", target_col)
    gains = bucket_gains(bucket_counts(held, buckets), bucket_counts(aim, buckets))
    kind = "doc_id long, n_words long, n_features long, weight long, score long"
    scored = materialize(held.mapInArrow(_weigh(gains, seed), kind), "scored")
    release(held)
    may = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    ranked, size = _numbered(scored.where(may))
    drawn = F.when(F.col("rank") <= percent * size // 100, F.col("rank"))
    rest = scored.where(~may).withColumn("rank", F.lit(None).cast("long"))
    return ranked.withColumn("rank", drawn).unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")


def _numbered(rows: DataFrame) -> tuple[DataFrame, int]:
    """(rows with ``rank`` by falling score, then id; their number).

    Ranges of the order are sorted and numbered in tasks of their own; what lies before a
    range is the sum of the earlier ones' sizes, one number a task.
    """
    order = [F.desc("score"), F.asc("doc_id"), F.asc("weight"), F.asc("n_features")]
    run = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    run = materialize(run, "ordered")
    place = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = run.groupBy(F.shiftright("at", 33).alias("part")).count().orderBy("part").collect()
    before, total = [], 0
    for r in sizes:
        before.append((r["part"], total))
        total += r["count"]
    start = run.sparkSession.createDataFrame(before, "part long, start long")
    out = run.withColumn("part", F.shiftright("at", 33)).join(F.broadcast(start), "part")
    return out.withColumn("rank", F.col("start") + place + 1).drop("part", "start", "at"), total
