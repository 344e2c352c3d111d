"""Texts as pieces that can be tokenised one by one, each kind of piece once."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import regex

# In a plain text every white space stands alone and is a space or a line feed.  A space
# then belongs to the match of the byte-level pre-tokenisation pattern that follows, and a
# line feed is a match of its own, so the text may be cut before either.
ODD = re.compile("[^\\S \n]|[\x02\x85\u180e]")
# In other texts a cut is safe before a space that a character other than white space follows.
_CUT = regex.compile(r"(?<=.)(?= \S)", regex.DOTALL | regex.V1)
#: Marks a key that is the piece itself; other keys stand for a space and the key.
BARE = "\x02"


_CLOSE = re.compile("[ \n][ \n]|[ \n]$")


def is_plain(text: str) -> bool:
    return text[0] not in " \n" and _CLOSE.search(text) is None and ODD.search(text) is None


def keys_of(text: str | None) -> list[str]:
    """Keys of the pieces of ``text`` in order; no match of the pattern spans two pieces."""
    if not text:
        return []
    words = text.replace("\n", " \n").split(" ")
    if "" in words or "\n" in words or ODD.search(text) is not None:
        return [BARE + p for p in _CUT.split(text)]
    words[0] = BARE + words[0]
    return words


def piece_of(key: str) -> str:
    return key[1:] if key[0] == BARE else key if key[0] == "\n" else " " + key


class _Index(dict):
    """key -> number in order of first use; ``new`` collects the keys that came in."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        self.new.append(key)
        return n


class PieceTable:
    """Ids of pieces, made once for each kind; forgotten when there are more than ``most``.

    ``make`` turns a list of keys into (ids of all, how many of each).
    """

    def __init__(self, make: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], kind: np.dtype, most: int = 400_000):
        self.make, self.kind, self.most = make, np.dtype(kind), most
        self.forget()

    def forget(self) -> None:
        """Back to an empty table; a worker that other jobs use next should not keep it."""
        self.index = _Index()
        self.ids, self.used = np.zeros(1 << 16, self.kind), 0
        self.start, self.count = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)

    def _room(self, name: str, size: int) -> np.ndarray:
        have = getattr(self, name)
        if len(have) < size:
            grown = np.zeros(max(size, 2 * len(have)), have.dtype)
            grown[: len(have)] = have
            setattr(self, name, grown)
            return grown
        return have

    def gather(self, lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all lists one after the other, how many each list has)."""
        if len(self.index) > self.most:
            self.forget()
        sizes = np.array([len(x) for x in lists], np.int64)
        at = np.fromiter(map(self.index.__getitem__, chain.from_iterable(lists)), np.int64, int(sizes.sum()))
        new, self.index.new = self.index.new, []
        if new:
            ids, counts = self.make(new)
            first, end = len(self.index) - len(new), self.used + len(ids)
            self._room("ids", end)[self.used : end] = ids
            self._room("count", len(self.index))[first : len(self.index)] = counts
            self._room("start", len(self.index))[first : len(self.index)] = self.used + np.cumsum(counts) - counts
            self.used = end
        count = self.count[at].astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(count)])
        flat = self.ids[np.repeat(self.start[at] - ends[:-1], count) + np.arange(ends[-1])]
        last = np.cumsum(sizes)
        return flat, ends[last] - ends[last - sizes]


def chunks(texts: list[str | None], chars: int = 1_000_000) -> Iterator[list[str | None]]:
    """``texts`` in order, in lists that hold about ``chars`` characters."""
    out, held = [], 0
    for t in texts:
        out.append(t)
        held += len(t or "")
        if held > chars:
            yield out
            out, held = [], 0
    if out:
        yield out


def encode_texts(table: PieceTable, texts: list[str | None]) -> Iterator[np.ndarray]:
    """Ids of each text."""
    for some in chunks(texts):
        flat, counts = table.gather([keys_of(t) for t in some])
        yield from np.split(flat, np.cumsum(counts)[:-1])
