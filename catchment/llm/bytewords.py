"""Words of many texts found, hashed and looked up as arrays of bytes, without a Python object for each."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

from .pieces import chunks
from .shingles import mix

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MARK = 2
_MOST_BYTES = 48 << 20
#: Of each byte: 1 space, line feed or mark; 2 ASCII letter or digit; 3 ASCII sign; 0 others.
_KIND = np.array([1 if b in (32, 10, _MARK) else 2 if chr(b).isalnum() and b < 128 else 3 if 32 < b < 127 else 0 for b in range(256)], np.uint8)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


class _Powers:
    """Powers of the hash's base and of its inverse modulo 2**64, as far as asked for."""

    up = _powers(_BASE, 1 << 12)
    down = _powers(_INVERSE, 1 << 12)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(cls.up):
            cls.up, cls.down = _powers(_BASE, 2 * n), _powers(_INVERSE, 2 * n)
        return cls.up[:n], cls.down[:n]


def cut(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every piece of a buffer of plain texts.

    A text begins with a mark, which is part of its first piece; a space or a line feed
    belongs to the piece that follows it.  An ASCII sign after an ASCII letter or digit
    begins a piece, too, as no match of the pre-tokenisation pattern spans the two.
    """
    kind = _KIND[raw]
    begins = kind == 1
    begins[1:] |= (kind[1:] == 3) & (kind[:-1] == 2)
    start = np.flatnonzero(begins)
    return start, np.append(start[1:], len(raw))


def hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each piece: a polynomial of its bytes and length, mixed."""
    up, down = _Powers.upto(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    h = (total[end] - total[start]) * down[start]
    return mix(h ^ ((end - start).astype(np.uint64) << np.uint64(40)))


class ByteTable:
    """Ids of pieces by their bytes; ``make`` turns a list of pieces into (ids of all, how many of each).

    Open addressing over a fixed number of slots by hash and first bytes.  The bytes of a
    hit are compared with those of the piece that is held; a piece that only hashes like
    another one gets a row of its own, which no slot names.  Emptied when it holds ``most``
    pieces or ``_MOST_BYTES`` of them.
    """

    def __init__(self, make: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], kind: np.dtype, most: int = 1_500_000):
        self.make, self.kind, self.most = make, np.dtype(kind), most
        self.slots = 1 << (2 * most).bit_length()
        self.forget()

    def forget(self) -> None:
        self.key = np.zeros(self.slots, np.uint64)
        self.check = np.zeros(self.slots, np.uint64)
        self.row = np.full(self.slots, -1, np.int32)
        self.n = 0
        self.ids, self.used = np.zeros(1 << 16, self.kind), 0
        self.start, self.count = np.zeros(self.most + (1 << 20), np.int64), np.zeros(self.most + (1 << 20), np.int32)
        self.place, self.size = np.zeros(self.most + (1 << 20), np.int64), np.zeros(self.most + (1 << 20), np.int64)
        self.bytes, self.told = np.zeros(1 << 20, np.uint8), 0

    def _find(self, h: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Row of each piece, -1 if it is not held."""
        slot = (h & np.uint64(self.slots - 1)).astype(np.int64)
        row = self.row[slot]
        other = np.flatnonzero((row >= 0) & ((self.key[slot] != h) | (self.check[slot] != check)))
        while len(other):
            slot[other] = (slot[other] + 1) & (self.slots - 1)
            at = slot[other]
            row[other] = self.row[at]
            other = other[(row[other] >= 0) & ((self.key[at] != h[other]) | (self.check[at] != check[other]))]
        return row

    def _insert(self, h: np.ndarray, check: np.ndarray) -> None:
        """Rows for distinct new pieces, in order."""
        slot = (h & np.uint64(self.slots - 1)).astype(np.int64)
        todo = np.arange(len(h))
        while len(todo):
            free = todo[self.row[slot[todo]] < 0]
            _, first = np.unique(slot[free], return_index=True)  # of several for one slot the first takes it
            won = free[first]
            at = slot[won]
            self.key[at], self.check[at], self.row[at] = h[won], check[won], self.n + won
            left = np.ones(len(h), bool)
            left[won] = False
            todo = todo[left[todo]]
            slot[todo] = (slot[todo] + (self.row[slot[todo]] >= 0)) & (self.slots - 1)
        self.n += len(h)

    def _hold(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        """Rows from ``self.n`` on for these pieces; the caller counts them or puts them into slots."""
        data = raw.tobytes()
        parts = [data[a:b] for a, b in zip(start.tolist(), end.tolist())]
        ids, counts = self.make([x.decode("utf-8", "surrogatepass") for x in parts])
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(ids)), self.kind)])
        self.ids[self.used : self.used + len(ids)] = ids
        rows = slice(self.n, self.n + len(start))
        if rows.stop > len(self.start):
            grow = rows.stop
            self.start, self.place, self.size = (np.concatenate([x, np.zeros(grow, np.int64)]) for x in (self.start, self.place, self.size))
            self.count = np.concatenate([self.count, np.zeros(grow, np.int32)])
        self.start[rows], self.count[rows] = self.used + np.cumsum(counts) - counts, counts
        self.used += len(ids)
        flat, size = np.frombuffer(b"".join(parts), np.uint8), end - start
        if self.told + len(flat) > len(self.bytes):
            self.bytes = np.concatenate([self.bytes, np.zeros(max(len(self.bytes), len(flat)), np.uint8)])
        self.bytes[self.told : self.told + len(flat)] = flat
        self.place[rows], self.size[rows] = self.told + np.cumsum(size) - size, size
        self.told += len(flat)

    def _others(self, raw: np.ndarray, start: np.ndarray, size: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Which pieces are not, byte for byte, those that their rows hold."""
        other = self.size[row] != size
        rest = np.flatnonzero((size > 7) & ~other)  # of shorter ones hash and first bytes tell all
        n = size[rest]
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        differ = raw[np.repeat(start[rest], n) + inside] != self.bytes[np.repeat(self.place[row[rest]], n) + inside]
        other[rest[np.repeat(np.arange(len(rest)), n)[differ]]] = True
        return np.flatnonzero(other)

    def gather(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces of a buffer, how many ids come before each text's mark, and at the end)."""
        if self.n > self.most or self.told > _MOST_BYTES:
            self.forget()
        start, end = cut(raw)
        size = end - start
        h = hashes(raw, start, end)
        padded = np.append(raw, np.zeros(8, np.uint8))
        head = np.lib.stride_tricks.sliding_window_view(padded, 8)[start]
        head = np.where(np.arange(8) < size[:, None], head, 0).astype(np.uint8)
        check = np.ascontiguousarray(head).view(np.uint64).ravel() ^ (size.astype(np.uint64) << np.uint64(56))
        row = self._find(h, check)
        new = np.flatnonzero(row < 0)
        if len(new):
            pair = np.empty(len(new), [("h", np.uint64), ("c", np.uint64)])
            pair["h"], pair["c"] = h[new], check[new]
            _, first = np.unique(pair, return_index=True)
            kinds = new[first]
            self._hold(raw, start[kinds], end[kinds])
            self._insert(h[kinds], check[kinds])
            row[new] = self._find(h[new], check[new])
        other = self._others(raw, start, size, row)
        if len(other):
            self._hold(raw, start[other], end[other])
            row[other] = self.n + np.arange(len(other))
            self.n += len(other)
        count = self.count[row].astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(count)])
        flat = self.ids[np.repeat(self.start[row] - ends[:-1], count) + np.arange(ends[-1])]
        return flat, np.append(ends[:-1][raw[start] == _MARK], ends[-1])


def encode_plain(table: ByteTable, texts: list[str | None], odd: Callable[[str], bool], alone: Callable[[list[str]], list[np.ndarray]]) -> Iterator[np.ndarray]:
    """Ids of each text; those for which ``odd`` is true go to ``alone``."""
    for some in chunks(texts):
        apart = [i for i, t in enumerate(some) if t and odd(t)]
        made = dict(zip(apart, alone([some[i] for i in apart]))) if apart else {}
        plain = ["" if i in made else (t or "") for i, t in enumerate(some)]
        raw = np.frombuffer(("\x02" + "\x02".join(plain)).encode("utf-8", "surrogatepass"), np.uint8)
        flat, at = table.gather(raw)
        for i in range(len(some)):
            yield made[i] if i in made else flat[at[i] : at[i + 1]]
