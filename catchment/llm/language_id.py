"""Languages of spans of text: script ranges, word scores, Viterbi.

A word's script narrows the languages it may belong to.  Within those, character
n-grams of the word score each language.  The best path through a text's words, where
each change of language costs a fixed penalty, labels its spans; the language that
holds most letters is the text's.

The model (n-gram counts by language and the scripts of each language) is learned
from a bounded sample of texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shingles import mix

UNKNOWN = "und"
GRAMS = (1, 2, 3, 4)
#: Cost of changing the language between two words, in units of log likelihood.
SWITCH = 12.0
#: A word tells no two languages apart by more than this.
CLIP = 6.0
# First code points of script blocks, and what they hold.
_STARTS = np.array([0, 0x250, 0x370, 0x400, 0x530, 0x590, 0x600, 0x700, 0x900, 0xE00, 0x10A0, 0x1100, 0x1E00, 0x1F00, 0x2C00, 0x3040, 0x30A0, 0x3400, 0xA000, 0xAC00, 0xD7B0, 0xF900, 0x10000, 0x20000])
_NAMES = ("latin", "other", "greek", "cyrillic", "other", "hebrew", "arabic", "other", "indic", "thai", "georgian", "hangul", "latin", "greek", "other", "hiragana", "katakana", "han", "other", "hangul", "other", "han", "other", "han")
SCRIPTS = tuple(sorted(set(_NAMES)))
_BLOCK_SCRIPT = np.array([SCRIPTS.index(n) for n in _NAMES])
_CHUNK_CHARS = 2_000_000
_WORDS_KEPT = 300_000


@lru_cache(maxsize=1)
def _letter_table() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def gram_rows(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """n-grams of many words at once: (word, hash) of each n-gram, then letters and script of each word.

    A run of letters has a mark at each end; other characters are marks.  A word's
    script is that of its first letter, -1 if it has none.
    """
    text = " " + " ".join(words).lower() + " "
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    word = np.cumsum(code == 32) - 1
    is_letter = _letter_table()[code.astype(np.int64)]
    letters = np.bincount(word[is_letter], minlength=len(words))[: len(words)]
    where = np.flatnonzero(is_letter)
    firsts = where[np.unique(word[where], return_index=True)[1]]
    script = np.full(len(words), -1)
    script[word[firsts]] = _BLOCK_SCRIPT[np.searchsorted(_STARTS, code[firsts], "right") - 1]
    c = np.where(is_letter, code, np.uint64(0))
    out_w, out_h = [], []
    for n in GRAMS:
        m = len(c) - n + 1
        h = np.full(m, n, np.uint64)
        for k in range(n):
            h = (h * np.uint64(0x9E3779B97F4A7C15) + c[k : k + m]) ^ (h >> np.uint64(29))
        if n <= 2:
            ok = is_letter[:m] | is_letter[n - 1 :]
        else:
            ok = np.all([is_letter[k : k + m] for k in range(1, n - 1)], axis=0)
        at = np.flatnonzero(ok)
        out_w.append(word[at + (~is_letter[at] if n < 3 else 1)])  # that of a letter inside
        out_h.append(mix(h[at]) >> np.uint64(4) << np.uint64(3) | np.uint64(n))
    return np.concatenate(out_w), np.concatenate(out_h).astype(np.int64), letters, script


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    prior: tuple[float, ...]
    scripts: tuple[tuple[int, ...], ...]
    grams: np.ndarray = field(repr=False, compare=False)
    counts: np.ndarray = field(repr=False, compare=False)
    stamp: int = 0


class Scorer:
    """Word scores of one model, kept by word; emptied when full."""

    def __init__(self, model: Model):
        n_lang, n_gram = len(model.languages), len(model.grams)
        size = model.grams & 7
        self.weights = np.zeros((n_gram + max(GRAMS) + 1, n_lang))
        for n in GRAMS:
            own = size == n
            total = model.counts[own].sum(axis=0) + 0.5 * max(own.sum(), 1)
            self.weights[:n_gram][own] = np.log(model.counts[own] + 0.5) - np.log(total)
            self.weights[n_gram + n] = np.log(0.5) - np.log(total)  # an n-gram not learned
        self.slots = 1 << max(12, (16 * n_gram).bit_length())
        order = np.argsort(model.counts.sum(axis=1), kind="stable")  # of two in one slot the commoner stays
        slot = self._slot(model.grams[order])
        self.key, self.row = np.zeros(self.slots, np.int64), np.zeros(self.slots, np.int64)
        self.key[slot], self.row[slot] = model.grams[order], order
        self.unseen = n_gram
        self.allowed = np.array([[s in own for own in model.scripts] for s in range(len(SCRIPTS))])
        self.n_lang = n_lang
        self.reset()

    def _slot(self, grams: np.ndarray) -> np.ndarray:
        return (grams >> 3) & (self.slots - 1)

    def reset(self) -> None:
        self.number: dict[str, int] = {}
        self.rows = np.zeros((0, self.n_lang))
        self.letters = np.zeros(0, np.int64)

    def learn(self, words: list[str]) -> None:
        """Score words that are not known yet."""
        word, gram, letters, script = gram_rows(words)
        slot = self._slot(gram)
        row = np.where(self.key[slot] == gram, self.row[slot], self.unseen + (gram & 7))
        s = np.stack([np.bincount(word, self.weights[row, k], len(words)) for k in range(self.n_lang)], axis=1) / 2
        # a script that no language is known to use tells nothing; others rule out languages
        allowed = np.where(script[:, None] >= 0, self.allowed[script], True)
        none = ~allowed.any(axis=1) | (script < 0)
        best = np.where(allowed, s, -np.inf).max(axis=1, keepdims=True)
        s = np.where(allowed, np.maximum(s - np.where(np.isfinite(best), best, 0), -CLIP), -CLIP)
        s[none] = 0
        self.number.update(zip(words, range(len(self.rows), len(self.rows) + len(words))))
        self.rows = np.concatenate([self.rows, s])
        self.letters = np.concatenate([self.letters, letters])

    def ids(self, words: list[str]) -> np.ndarray:
        if len(self.number) > _WORDS_KEPT:
            self.reset()
        missing = list(set(words).difference(self.number))
        if missing:
            self.learn(missing)
        return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))


@lru_cache(maxsize=2)
def _scorer(model: Model) -> Scorer:
    return Scorer(model)


def viterbi(scores: np.ndarray, lengths: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best labels of several texts at once.

    ``scores``: (all words, languages), texts one after the other; ``lengths``: words of
    each text.  Returns a label for each word.  Among equal paths: stay, then the first
    language.
    """
    n_lang = scores.shape[1]
    out = np.zeros(len(scores), np.int8)
    order = np.argsort(-lengths, kind="stable")
    lengths, first = lengths[order], (np.cumsum(lengths) - lengths)[order]
    steps = int(lengths[0]) if len(lengths) else 0
    if not steps:
        return out
    active = np.searchsorted(-lengths, -np.arange(steps), "left")  # texts longer than t
    value = scores[first[: active[0]]].copy()
    moved = np.zeros((len(scores), n_lang), bool)
    origin = np.zeros(len(scores), np.int8)
    for t in range(1, steps):
        k = active[t]
        v, at = value[:k], first[:k] + t
        top = v.argmax(axis=1)
        jump = v[np.arange(k), top] - switch
        go = jump[:, None] > v
        moved[at], origin[at] = go, top
        value[:k] = np.where(go, jump[:, None], v) + scores[at]
    label = value.argmax(axis=1).astype(np.int8)
    for t in range(steps - 1, -1, -1):
        k = active[t]
        at = first[:k] + t
        out[at] = label[:k]
        if t:
            go = moved[at, label[:k]]
            label[:k] = np.where(go, origin[at], label[:k])
    return out


def label_texts(texts: list[str | None], model: Model) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """(words, label of each word, letters of each word) of each text."""
    scorer, todo, held = _scorer(model), [], 0

    def flush():
        words = [(t or "").split() for t in todo]
        flat = scorer.ids([x for w in words for x in w])
        lengths = np.array([len(w) for w in words])
        labels, letters = viterbi(scorer.rows[flat], lengths), scorer.letters[flat]
        ends = np.cumsum(lengths)
        for w, a, b in zip(words, ends - lengths, ends):
            yield w, labels[a:b], letters[a:b]

    for t in texts:
        todo.append(t)
        held += len(t or "")
        if held > _CHUNK_CHARS:
            yield from flush()
            todo, held = [], 0
    if todo:
        yield from flush()


def predict_texts(texts: list[str | None], model: Model) -> tuple[list[str], list[float]]:
    """The language with most letters in each text, and its share of them."""
    if not model.languages:  # nothing was learned
        return [UNKNOWN] * len(texts), [0.0] * len(texts)
    lang, share = [], []
    prior = np.array(model.prior)
    for _, labels, letters in label_texts(texts, model):
        held = np.bincount(labels, weights=letters, minlength=len(prior))[: len(prior)] if len(labels) else np.zeros(len(prior))
        total = held.sum()
        if not total:
            lang.append(UNKNOWN)
            share.append(0.0)
        else:
            k = int(np.lexsort((-prior, -held))[0])
            lang.append(model.languages[k])
            share.append(float(held[k] / total))
    return lang, share


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n-gram counts by language over the task's part of the sample; letters by script under negative keys."""
    words: dict[str, Counter] = {}
    for b in batches:
        for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            words.setdefault(lang, Counter()).update((text or "").split())
    for lang, count in words.items():
        times = np.fromiter(count.values(), np.int64, len(count))
        word, gram, letters, script = gram_rows(list(count))
        keys, at = np.unique(gram, return_inverse=True)
        n = np.bincount(at, times[word], len(keys))
        by_script = np.bincount(script + 1, times * letters, len(SCRIPTS) + 1)[1:]
        used = np.flatnonzero(by_script)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * (len(keys) + len(used)), pa.string()), pa.array(np.concatenate([keys, -1 - used])),
             pa.array(np.concatenate([n, by_script[used]]).astype(np.int64))],
            ["lang", "gram", "n"],
        )


def learn_languages(labelled: DataFrame, min_count: int = 3) -> Model:
    """Model from (text, lang) rows, a bounded sample; its n-grams of ``min_count`` or more come to the driver.

    Rows without text or language tell nothing; no rows: a model without languages.
    """
    sample = labelled.where("text is not null and lang is not null").select("text", "lang")
    counts = sample.mapInArrow(_count_grams, "lang string, gram long, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    by_gram = counts.groupBy("gram").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"), F.sum("n").alias("n"))
    rows = by_gram.where(f"gram < 0 or n >= {min_count}").orderBy("gram").collect()
    scripts = {-1 - r["gram"]: r["by"] for r in rows if r["gram"] < 0}
    rows = [r for r in rows if r["gram"] >= 0]
    languages = tuple(sorted({x for by in scripts.values() for x in by}))
    letters = np.array([sum(by.get(x, 0) for by in scripts.values()) for x in languages], float)
    own = tuple(tuple(s for s, by in sorted(scripts.items()) if by.get(x, 0) >= 0.01 * n) for x, n in zip(languages, letters))
    grams = np.array([r["gram"] for r in rows], np.int64)
    counted = np.array([[r["by"].get(x, 0) for x in languages] for r in rows], np.float64).reshape(len(rows), len(languages))
    stamp = hash((grams.tobytes(), counted.tobytes()))
    return Model(languages, tuple((letters / max(letters.sum(), 1)).tolist()), own, grams, counted, stamp)


def identify_languages(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score): the language of most letters of each whole text, and its share.

    Null texts and texts without a letter: ``und`` with score 0.  Repeated rows: a row
    each.  Empty table: no rows.  Other columns are ignored.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, share = predict_texts(b.column(1).to_pylist(), shipped.value)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(share, pa.float64())], ["doc_id", "lang_pred", "score"])

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return d.mapInArrow(run, "doc_id long, lang_pred string, score double")


def language_spans(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): runs of words of one language, as array of (first_word, n_words, lang); null text: no spans."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("first_word", pa.int32()), ("n_words", pa.int32()), ("lang", pa.string())]))
        for b in batches:
            out = []
            for _, labels, _ in label_texts(b.column(1).to_pylist(), shipped.value):
                cut = np.flatnonzero(np.diff(labels)) + 1
                ends = [*cut.tolist(), len(labels)] if len(labels) else []
                starts = [0, *ends[:-1]] if ends else []
                out.append([{"first_word": a, "n_words": z - a, "lang": shipped.value.languages[labels[a]]} for a, z in zip(starts, ends)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, kind)], ["doc_id", "spans"])

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return d.mapInArrow(run, "doc_id long, spans array<struct<first_word: int, n_words: int, lang: string>>")
