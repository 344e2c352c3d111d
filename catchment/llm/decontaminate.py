"""Benchmark questions in documents, also with other numbers, names and units.

Texts become templates: numbers, units after a number and capitalised words inside a
sentence turn into typed placeholders; other words are lower-cased without the signs
around them.  A run of names or of number words is one placeholder.  A capitalised word
that opens a sentence may be a name or not, so each text is read both ways, words of a
fixed list apart.  Windows of template words are hashed and joined with the benchmark's.
What stood in the placeholders is kept: along one alignment of a document with an item
each of the item's values must always meet the same value, and no two of them the
same one.  Windows that break this do not count.  An alignment may shift where words
were put in or left out, as long as both texts go on in the same order.

The same words are also read as they stand, placeholders filled and case folded: each
window of these is looked for too, so that an item of few words, or of hardly any but
numbers and names, is found by its copies.  The best share of these readings counts.
Characters are words in scripts that put no spaces between words.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..session import materialize

WINDOW = 8
#: The benchmark's windows are broadcast up to this number, a few dozen bytes each.
BROADCAST_WINDOWS = 100_000
#: Literal words that a template window must hold; windows of the words as they stand need none.
LITERALS = 4
# How the words are read: as templates with opening words as literals or as names, as they stand.
TEMPLATE, NAMED, PLAIN = range(3)
_CHUNK_CHARS = 2_000_000
_WORDS_KEPT = 400_000
_BITS_EACH, _MAX_BITS = 64, 1 << 27
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
# Kinds of template words.
LITERAL, NUMBER, UNIT, NAME = range(4)
# Words for numbers, and units of measure.
NUMBER_WORDS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen "
    "nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion half dozen".split()
)
UNITS = frozenset(
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons tonne tonnes lb lbs oz "
    "pound pounds ounce ounces ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours "
    "day days week weeks month months year years usd eur dollar dollars euro euros cent cents percent degree degrees kmh mph hz khz "
    "mhz ghz kb mb gb tb w kw volt volts watt watts joule joules newton newtons".split()
)
# Words that open sentences and are no names.
OPENING_WORDS = frozenset(
    "a an the this that these those each every all any some both no not only i you he she it we they my your his her its our their "
    "who whom whose what which when where why how if as so then than thus hence there here and or but nor yet for from of in on at by to "
    "with without within into onto over under between among after before during until since while because although though once "
    "is are was were be been being am do does did has have had can could will would shall should may might must let lets "
    "find compute calculate determine solve evaluate estimate simplify show prove explain describe write list name give state choose "
    "select suppose assume consider given note first second third next finally also now later today however therefore after one another "
    "el la los las un una unos unas de del en con por para que se lo su y o si al es son "
    "der die das den dem ein eine einer und oder mit von zu im ist sind wenn wie was wer wo le les des du et ou dans sur est sont une pour".split()
)
_ENDS, _BREAKS, _OPENING, _NUMBER_WORD = 1, 2, 4, 8
_NUMBER = re.compile(r"[+-]?\d[\d.,:/]*")
_NUMBER_UNIT = re.compile(r"([+-]?\d[\d.,]*)([^\W\d_]+|%|°)")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
# what _EDGE takes off a word of ASCII
_SIGNS = "".join(c for c in map(chr, range(128)) if not c.isalnum())
# Thai, Lao, Tibetan, Myanmar, Khmer, kana, Han, with the marks that follow a letter; Hangul is written with spaces.
_UNSPACED = "\u0e01-\u0e30\u0e32-\u0e33\u0e40-\u0e46\u0e81-\u0eb0\u0eb2-\u0eb3\u0ec0-\u0ec6\u0f40-\u0f6c\u1000-\u102a\u1780-\u17b3\u3005-\u3007\u3041-\u3096\u309d-\u309f\u30a1-\u30fa\u30fc-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
_MARKS = "\u0e31\u0e34-\u0e3a\u0e47-\u0e4e\u0eb1\u0eb4-\u0ebc\u0ec8-\u0ece\u0f71-\u0f84\u0f90-\u0fbc\u102b-\u103e\u17b4-\u17d3\u3099\u309a"
_LETTER = re.compile(f"[{_UNSPACED}][{_MARKS}]*")
_PIECES = re.compile(f"[{_UNSPACED}][{_MARKS}]*|[^{_UNSPACED}]+")


class _Made(dict):
    """Entries by raw word, made when first asked for."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, raw: str) -> tuple[int, ...]:
        return self.make(raw)


class Words:
    """Raw words -> numbers of entries; an entry is a template word with its value."""

    def __init__(self):
        self.reset()

    def reset(self) -> None:
        self.number = _Made(self.entries)
        self.hash, self.kind, self.flags = array("Q"), array("b"), array("b")

    def _entry(self, literal: str, kind: int, flags: int) -> int:
        self.hash.append(xxhash.xxh3_64_intdigest(literal))
        self.kind.append(kind)
        self.flags.append(flags)
        return len(self.hash) - 1

    def entries(self, raw: str) -> tuple[int, ...]:
        """Numbers of the entries of a raw word not seen before."""
        plain = raw.isascii()
        if not plain and _LETTER.search(raw):
            found = self.number[raw] = tuple(chain.from_iterable(self.pieces(x) for x in _PIECES.findall(raw)))
            return found
        if raw.isalpha():
            flags, word = 0, raw
        else:
            ends = raw[-1] == "\x1f" or raw.rstrip("\"')]}\x1f")[-1:] in (".", "!", "?", ":")
            flags = _ENDS * ends | _BREAKS * (ends or raw[-1] in ",;)]}")
            word = raw.strip(_SIGNS) if plain else _EDGE.sub("", raw)
        low = word.lower()
        # a number begins with a digit, as signs are gone
        digit = low[:1].isdecimal()
        both = digit and _NUMBER_UNIT.fullmatch(low)
        if not word:
            found = ()
        elif digit and _NUMBER.fullmatch(low):
            found = (self._entry(low, NUMBER, flags),)
        elif low in NUMBER_WORDS or "-" in low and NUMBER_WORDS.issuperset(low.split("-")):
            found = (self._entry(low, NUMBER, flags | _NUMBER_WORD),)
        elif both and (both[2] in UNITS or both[2] in "%°"):
            found = (self._entry(both[1], NUMBER, 0), self._entry(both[2], UNIT, flags))
        else:
            kind = UNIT if low in UNITS else NAME if word[0].isupper() and not word.isupper() else LITERAL
            found = (self._entry(low, kind, flags | _OPENING if low in OPENING_WORDS else flags),)
        self.number[raw] = found
        return found

    def pieces(self, piece: str) -> tuple[int, ...]:
        """Entries of a part of a raw word: a letter of an unspaced script, or what stands between such."""
        if not _LETTER.match(piece):
            return self.number[piece]
        found = self.number.get(piece)
        if found is None:
            found = self.number[piece] = (self._entry(piece, LITERAL, 0),)
        return found


_WORDS = Words()


def _collapsed(text: np.ndarray, kind: np.ndarray, value: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of names, or of a number and number words after it, as one placeholder each."""
    joins = np.zeros(len(kind), bool)
    joins[1:] = (text[1:] == text[:-1]) & (kind[1:] == kind[:-1]) & (flags[:-1] & _BREAKS == 0)
    joins &= (kind == NAME) | (kind == NUMBER) & (flags & _NUMBER_WORD > 0)
    later, start = np.flatnonzero(joins), np.flatnonzero(~joins)
    if not len(later):
        return text, kind, value
    value = value.copy()
    value[later] *= np.power(_FACTOR, (later - start[np.searchsorted(start, later) - 1]).astype(np.uint64))
    return text[start], kind[start], np.add.reduceat(value, start)


def templates(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each reading (text, kind, hash) of the words of several texts, one after the other.

    For placeholders the hash is that of the value.
    """
    w = _WORDS
    if len(w.number) > _WORDS_KEPT:
        w.reset()
    rows = [(t or "").replace("\n", "\x1f\n").split() for t in texts]
    raw = pa.array(list(chain.from_iterable(rows)), pa.large_string()).dictionary_encode()
    # each kind of raw word is looked up once; a word may have no entry or several
    found = list(map(w.number.__getitem__, raw.dictionary.to_numpy(zero_copy_only=False).tolist()))
    size = np.fromiter(map(len, found), np.int64, len(found))
    entry = np.fromiter(chain.from_iterable(found), np.int64, size.sum())
    word = raw.indices.to_numpy()
    each, begin = size[word], (np.cumsum(size) - size)[word]
    upto = np.concatenate([[0], np.cumsum(each)])
    at = entry[np.repeat(begin - upto[:-1], each) + np.arange(upto[-1])]
    counts = np.diff(upto[np.cumsum([0, *map(len, rows)])])
    if not len(at):  # an array of no entries has no buffer
        none = at, at.astype(np.int8), at.astype(np.uint64)
        return [none, none, none]
    kind, flags = np.frombuffer(w.kind, np.int8)[at], np.frombuffer(w.flags, np.int8)[at]
    value = np.frombuffer(w.hash, np.uint64)[at]
    text = np.repeat(np.arange(len(texts)), counts)
    first = np.ones(len(at), bool)  # of a sentence
    first[1:] = (text[1:] != text[:-1]) | (flags[:-1] & _ENDS > 0)
    after = np.zeros(len(at), bool)  # a number
    after[1:] = (text[1:] == text[:-1]) & (kind[:-1] == NUMBER)
    opening = (kind == NAME) & first
    kind = np.where(opening | (kind == UNIT) & ~after, LITERAL, kind).astype(np.int8)
    named = np.where(opening & (flags & _OPENING == 0), NAME, kind).astype(np.int8)
    return [_collapsed(text, kind, value, flags), _collapsed(text, named, value, flags), (text, np.zeros_like(kind), value)]


def _hashes(word: np.ndarray, width: int) -> np.ndarray:
    """Of every ``width`` words in a row; hashes of 1, 2, 4, ... words are put together."""
    m = len(word) - width + 1
    h, done, part, size, factor = np.zeros(m, np.uint64), 0, word, 1, int(_FACTOR)
    while True:
        if width & size:
            h = h * np.uint64(factor) + part[done : done + m]
            done += size
        if 2 * size > width:
            return h
        part = part[:-size] * np.uint64(factor) + part[size:]
        size, factor = 2 * size, factor * factor % (1 << 64)


def window_hashes(text: np.ndarray, kind: np.ndarray, value: np.ndarray, width: int, reading: int = TEMPLATE) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of the windows that lie in one text and, as templates, hold literals enough."""
    m = len(value) - width + 1
    if m <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    inside = text[:m] == text[width - 1 :]
    if reading == PLAIN:
        word = value
    else:
        word = np.where(kind == LITERAL, value, kind.astype(np.uint64))
        literal = np.concatenate([[0], np.cumsum(kind == LITERAL)])
        inside &= literal[width:] - literal[:-width] >= LITERALS
    at = np.flatnonzero(inside)
    h = (_hashes(word, width)[at] + np.uint64(width + 2 * WINDOW * reading)) * _FACTOR
    return at, h ^ (h >> np.uint64(32))


_SHIFTS = (0, 21, 42)


def _slot(h: np.ndarray, shift: int, bits: int) -> np.ndarray:
    return ((h >> np.uint64(shift)) * _FACTOR >> np.uint64(32)) & np.uint64(bits - 1)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    ids, texts, held = [], [], 0
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            ids.append(i), texts.append(t)
            held += len(t or "")
            if held > _CHUNK_CHARS:
                yield ids, texts
                ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def _held(h: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    """Places of the hashes that the bitmap may hold; each probe looks only at what the one before left."""
    at = np.arange(len(h))
    for shift in _SHIFTS:
        p = _slot(h[at], shift, 8 * len(bitmap))
        at = at[(bitmap[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 > 0]
    return at


def _window_rows(kinds: tuple[tuple[int, int], ...], bitmap: np.ndarray | None = None):
    """(id, text) -> rows (id, reading, width, h, pos, slots, n_windows); kinds are pairs (reading, width).

    Without a bitmap the texts are items: one window of its own width for a short text.
    With it they are documents, and only windows that the bitmap may hold are returned.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _chunks(batches):
            read, ids = templates(texts), np.array(ids, np.int64)
            starts = [np.searchsorted(text, np.arange(len(texts) + 1)) for text, _, _ in read]
            for reading, width in kinds:
                (text, kind, value), start = read[reading], starts[reading]
                size = np.diff(start)
                at, h = window_hashes(text, kind, value, width, reading)
                if bitmap is None:
                    own = np.minimum(size[text[at]], WINDOW) == width
                    at, h = at[own], h[own]
                total = np.bincount(text[at], minlength=len(texts))
                if bitmap is not None:
                    may = _held(h, bitmap)
                    at, h = at[may], h[may]
                if len(at):
                    filled = [np.flatnonzero(kind[i : i + width] != LITERAL) + i if reading != PLAIN else [] for i in at.tolist()]
                    slots = [(value[f] >> np.uint64(1)).astype(np.int64).tolist() if len(f) else [] for f in filled]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[text[at]]), pa.array(np.full(len(at), reading, np.int32)), pa.array(np.full(len(at), width, np.int32)),
                         pa.array(h.astype(np.int64)), pa.array(at - start[text[at]]), pa.array(slots, pa.list_(pa.int64())), pa.array(total[text[at]])],
                        ["id", "reading", "width", "h", "pos", "slots", "n_windows"],
                    )
        _WORDS.reset()  # workers are used for other jobs next

    return run


_ROW = "id long, reading int, width int, h long, pos long, slots array<long>, n_windows long"


def _bitmap(windows: DataFrame, n: int) -> np.ndarray:
    """Bloom filter of the benchmark's windows: 64 bits each, 16 MB at most; false hits fall out in the join."""
    bits = min(_MAX_BITS, 1 << max(16, (n * _BITS_EACH - 1).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(bits // 8, np.uint8)
        for b in batches:
            h = b.column(0).to_numpy(zero_copy_only=False).astype(np.uint64)
            for p in (_slot(h, shift, bits) for shift in _SHIFTS):
                np.bitwise_or.at(out, (p >> np.uint64(3)).astype(np.int64), (np.uint8(1) << (p & np.uint64(7)).astype(np.uint8)))
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["bits"])

    whole = np.zeros(bits // 8, np.uint8)
    for r in windows.select("h").distinct().coalesce(4).mapInArrow(run, "bits binary").toLocalIterator():
        whole |= np.frombuffer(r["bits"], np.uint8)
    return whole


def _chains(hits: list[tuple[int, int, list[int], list[int]]]) -> list[dict[int, tuple[list[int], list[int]]]]:
    """Hits in rising order in both texts; from one to the next a document goes at most WINDOW words further than twice the item's way."""
    out: list[dict] = []
    by_shift: dict[int, int] = {}
    last: list[tuple[int, int]] = []  # (pos, item_pos) of each chain
    newest: dict[int, int] = {}  # last item_pos -> the newest chain that stands there
    for pos, item_pos, slots, item_slots in sorted(hits, key=lambda x: x[:2]):
        c = by_shift.get(pos - item_pos)
        if c is None or last[c][0] >= pos or last[c][1] >= item_pos:
            near = [
                (abs(pos - item_pos - last[x][0] + i), -i, x) for i, x in newest.items()
                if i < item_pos and last[x][1] == i and 0 < pos - last[x][0] <= 2 * (item_pos - i) + WINDOW
            ]
            c = min(near)[2] if near else len(out)
            if not near:
                out.append({})
                last.append((pos, item_pos))
        out[c][item_pos] = (slots, item_slots)
        last[c] = (pos, item_pos)
        by_shift[pos - item_pos] = newest[item_pos] = c
    return out


def _best_alignment(hits: list[tuple[int, int, list[int], list[int]]]) -> tuple[int, bool]:
    """Most windows that one alignment matches consistently, and whether all its values are the item's own."""
    by_shift: dict[int, dict[int, tuple[list[int], list[int]]]] = defaultdict(dict)
    for pos, item_pos, slots, item_slots in hits:
        by_shift[pos - item_pos].setdefault(item_pos, (slots, item_slots))
    best = (0, False)
    for windows in chain(by_shift.values(), _chains(hits) if len(by_shift) > 1 else ()):
        votes: dict[int, Counter] = defaultdict(Counter)
        for slots, item_slots in windows.values():
            for mine, theirs in zip(slots, item_slots):
                votes[theirs][mine] += 1
        chosen: dict[int, int] = {}
        for theirs, c in sorted(votes.items(), key=lambda v: (-max(v[1].values()), v[0])):
            free = [m for m, _ in sorted(c.items(), key=lambda x: (-x[1], x[0])) if m not in chosen.values()]
            if free:
                chosen[theirs] = free[0]
        fits = [w for w in windows.values() if len(w[0]) == len(w[1]) and all(chosen.get(t) == m for m, t in zip(*w))]
        best = max(best, (len(fits), all(m == t for w in fits for m, t in zip(*w))))
    return best


def _check_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, of, same = [], [], []
        for hits in b.column(2).to_pylist():
            by_reading: dict[tuple[int, int], list] = defaultdict(list)
            for x in hits:
                by_reading[x["reading"], x["n_windows"]].append((x["pos"], x["item_pos"], x["slots"], x["item_slots"]))
            found = [(*_best_alignment(h), windows, reading) for (reading, windows), h in by_reading.items()]
            count, verbatim, windows, _ = max(found, key=lambda x: (x[0] / x[2], -x[3]))
            n.append(count)
            of.append(windows)
            same.append(verbatim)
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(of, pa.int64()), pa.array(same, pa.bool_())],
            ["doc_id", "item_id", "n_matched", "n_windows", "verbatim"],
        )


def find_leaks(docs: DataFrame, benchmark: DataFrame, min_share: float = 0.3, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Documents that hold a benchmark item: (doc_id, item_id, n_matched, n_windows, share, verbatim).

    A row for each pair in which one alignment matches ``min_share`` of the item's windows
    or more with consistent placeholders; ``verbatim`` if all values are the item's own.
    The windows are those of one reading, of the templates or of the words as they stand: the one with the largest share.
    Whole texts are searched, every item and document takes part.

    Null or empty texts, and those of signs alone, hold nothing; an item shorter than a
    window is one window, and a single word is found wherever it stands.  Null ids give no row.
    Repeated rows count once.  Empty tables: no rows.  Other columns are ignored.
    """
    items = benchmark.select(F.col(item_col).cast("long").alias("id"), F.col(item_text_col).cast("string").alias("text"))
    items = items.where("id is not null and text is not null").distinct()
    every = tuple((r, w) for r in (TEMPLATE, NAMED, PLAIN) for w in range(1 if r == PLAIN else LITERALS, WINDOW + 1))
    windows = materialize(items.mapInArrow(_window_rows(every), _ROW), "item_windows")
    kinds = sorted((r["reading"], r["width"], r["n"]) for r in windows.groupBy("reading", "width").agg(F.count("*").alias("n")).collect())  # as many as in every
    used = sum(n for *_, n in kinds)
    bitmap = docs.sparkSession.sparkContext.broadcast(_bitmap(windows, max(used, 1)))
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _window_rows(tuple((r, w) for r, w, _ in kinds), bitmap.value)(batches)

    key = ["reading", "width", "h"]
    found = d.mapInArrow(search, _ROW).select(F.col("id").alias("doc_id"), *key, "pos", "slots")
    theirs = windows.select(F.col("id").alias("item_id"), *key, F.col("pos").alias("item_pos"), F.col("slots").alias("item_slots"), "n_windows")
    hits = found.join(F.broadcast(theirs) if used <= BROADCAST_WINDOWS else theirs, key)
    # a pair's hits are bounded by the document's length
    pairs = hits.groupBy("doc_id", "item_id").agg(F.collect_list(F.struct("reading", "n_windows", "pos", "item_pos", "slots", "item_slots")).alias("hits"))
    pairs = pairs.mapInArrow(_check_slots, "doc_id long, item_id long, n_matched long, n_windows long, verbatim boolean")
    share = F.col("n_matched") / F.col("n_windows")
    return pairs.withColumn("share", share).where(F.col("share") >= min_share).select("doc_id", "item_id", "n_matched", "n_windows", "share", "verbatim")
