"""Words and word shingles of whole texts as 64-bit hashes, for use inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

# Lower-cases A-Z on UTF-8 bytes; bytes.split() without an argument parts at 0x20 and 0x09-0x0D.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_CACHE_WORDS = 400_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _WordHash(dict):
    """Word -> 64-bit hash. Emptied when full, so memory stays bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE_WORDS:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) < 64:
            self[word] = h
        return h


_HASH = _WordHash()


def forget() -> None:
    """Give the cache back; at the end of a task, as workers are used for other jobs next."""
    _HASH.clear()


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []


def word_hashes(ws: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASH.__getitem__, ws), np.uint64, len(ws))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits (splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """One hash for each window of ``width`` words; the whole sequence if it is shorter."""
    if not len(h):
        return h
    width = min(width, len(h))
    out = h[: len(h) - width + 1] + np.uint64(width)
    for k in range(1, width):
        out = mix(out * _MIX) + h[k : len(h) - width + 1 + k]
    return mix(out)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text."""
    return np.unique(windows(word_hashes(words(text)), width))
