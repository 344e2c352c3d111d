"""Byte-level BPE as a lazily determinised transducer, and streaming decoding.

Merging by rank forms every token of a word at its own rank, whatever stands around
it, unless a merge across the border to a neighbour comes first.  So a sequence of
tokens is the encoding of its bytes exactly if each adjacent pair is (``fits``), and
every prefix of a word has one last token.  ``Transducer`` reads bytes from left to
right.  Its open readings, the tokens begun at some place and not yet whole, are a set of
places in the vocabulary's trie; sets become states of a deterministic machine when they
first occur.  Of the tokens that end at a byte, the one that fits the last token before
it is the last token there.  A token leaves once all open readings agree on it, so it
waits for less than the longest token's bytes.
"""

from __future__ import annotations

import base64
import codecs
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from .memory import tidy
from .pieces import PieceTable, encode_texts, piece_of

_FOREVER = 1 << 60
#: Bytes of a word kept before what is settled leaves.
_PENDING = 1024
#: Longer words are encoded one by one.
_WIDE = 64
_PAIRS = 1 << 20


def read_ranks(content: bytes) -> dict[bytes, int]:
    """token -> id from lines of base64 token and rank."""
    return {base64.b64decode(t): int(r) for t, r in map(bytes.split, content.splitlines()) if t}


class Transducer:
    """Encodes one pre-tokenised word; all single bytes must be tokens."""

    def __init__(self, ranks: dict[bytes, int], most_pairs: int = 400_000):
        self.ranks, self.most = ranks, most_pairs
        self.token = [b""] * (max(ranks.values()) + 1)
        self.child: dict[int, int] = {}
        self.ends: list[int] = [-1]
        for word, rank in ranks.items():
            self.token[rank] = word
            node = 0
            for b in word:
                nxt = self.child.get(node << 8 | b)
                if nxt is None:
                    nxt = self.child[node << 8 | b] = len(self.ends)
                    self.ends.append(-1)
                node = nxt
            self.ends[node] = rank
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._spines: dict[int, tuple] = {}
        self._fits: dict[int, bool] = {}
        self._number: dict[tuple, int] = {(): 0}
        self._open: list[tuple[tuple[int, int], ...]] = [()]
        self._whole: list[tuple[tuple[int, int], ...]] = [()]
        self._hops: dict[int, int] = {}
        self._size = np.array([len(t) for t in self.token], np.int32)
        # the same machine as arrays, for many words at once
        self._next = np.full((1024, 256), -1, np.int32)
        self._ends = np.full((1024, 8), -1, np.int32)
        self._pair, self._pair_fits = np.full(_PAIRS, -1, np.int64), np.zeros(_PAIRS, bool)

    # which tokens can stand side by side

    def halves(self, t: int) -> tuple[int, int] | None:
        """The two tokens whose merge forms ``t``; None for a byte; (-1, -1) if merging by rank never forms it."""
        if t not in self._halves:
            word = self.token[t]
            parts = [word[i : i + 1] for i in range(len(word))]
            while len(parts) > 2:
                rank, at = min(((self.ranks.get(x + y, _FOREVER), i) for i, (x, y) in enumerate(zip(parts, parts[1:]))))
                if rank == _FOREVER:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self._halves[t] = None if len(word) == 1 else (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else (-1, -1)
        return self._halves[t]

    def _spine(self, t: int, right: int) -> tuple:
        """Tokens at the right (left) edge of ``t`` while it forms: (bytes, rank at which the next one takes over)."""
        key = t << 1 | right
        found = self._spines.get(key)
        if found is None:
            out, grows, h = [], _FOREVER, t
            while True:
                out.append((self.token[h], grows))
                grows, parts = h, self.halves(h)
                if parts is None:
                    break
                h = parts[right]
            found = self._spines[key] = tuple(out[::-1])
        return found

    def fits(self, a: int, b: int) -> bool:
        """No merge across the border of ``a`` and ``b`` comes before both are whole."""
        left, right, rank = self._spine(a, 1), self._spine(b, 0), self.ranks.get
        i = j = 0
        x, grow_a = left[0]
        y, grow_b = right[0]
        while True:
            across = rank(x + y, _FOREVER)
            if across < grow_a and across <= grow_b and across != _FOREVER:
                return False  # of equal ranks the one further left is merged first
            if grow_a <= grow_b:
                if grow_a == _FOREVER:
                    return True
                i += 1
                x, grow_a = left[i]
            else:
                j += 1
                y, grow_b = right[j]

    # the deterministic machine, built as words need it

    def _grow(self, state: int, byte: int) -> int:
        """The state after one more byte: open readings as (trie place, bytes read), and tokens whole here."""
        reads = [(self.child.get(node << 8 | byte), n + 1) for node, n in (*self._open[state], (0, 0))]
        reads = tuple((node, n) for node, n in reads if node is not None)
        to = self._number.get(reads)
        if to is None:
            to = self._number[reads] = len(self._open)
            self._open.append(reads)
            self._whole.append(tuple((self.ends[node], n) for node, n in reads if self.ends[node] >= 0 and self.halves(self.ends[node]) != (-1, -1)))
        self._hops[state << 8 | byte] = to
        return to

    def encode(self, word: bytes) -> list[int]:
        if len(self._fits) > self.most:
            self._fits.clear()
        hops, whole, known = self._hops, self._whole, self._fits
        last, state, out, base = [-1], 0, [], 0  # last[k]: the last token of the word up to byte base + k
        for at, byte in enumerate(word, 1):
            hop = hops.get(state << 8 | byte)
            state = self._grow(state, byte) if hop is None else hop
            for token, n in whole[state]:
                before = last[at - n - base]
                if before >= 0:
                    pair = before << 20 | token
                    ok = known.get(pair)
                    if ok is None:
                        ok = known[pair] = self.fits(before, token)
                    if not ok:
                        continue
                last.append(token)
                break
            if len(last) > _PENDING:
                base += self._settle(last, out, max((n for _, n in self._open[state]), default=0))
        self._back(last, len(last) - 1, out, len(out))
        return out

    def encode_many(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, how many each has); all words advance a byte at a time together."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        wide = np.flatnonzero(size > _WIDE)
        order = np.argsort(-np.where(size > _WIDE, 0, size), kind="stable")
        n = size[order] * (size[order] <= _WIDE)
        steps = int(n[0]) if len(n) else 0
        row = np.repeat(np.arange(len(n)), n)
        text = np.zeros((len(n), steps), np.uint8)
        text[row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)] = np.frombuffer(b"".join([words[i] for i in order if size[i] <= _WIDE]), np.uint8)
        last = np.full((len(n), steps + 1), -1, np.int32)
        state = np.zeros(len(n), np.int64)
        for at in range(steps):
            k = int(np.searchsorted(-n, -at, "left"))  # words longer than that
            state[:k] = self._hop_many(state[:k], text[:k, at])
            todo, slot = np.arange(k), 0
            while len(todo):
                token = self._ends[state[todo], slot]
                before = last[todo, at + 1 - self._size[token]]
                ok = (token >= 0) & ((before < 0) | self._fit_many(before, token))
                last[todo[ok], at + 1] = token[ok]
                todo, slot = todo[~ok], slot + 1
        # from the end back to the start
        place, found = n.copy(), []
        while (live := np.flatnonzero(place > 0)).size:
            token = last[live, place[live]]
            found.append((live, token))
            place[live] -= self._size[token]
        count = np.zeros(len(n), np.int64)
        for live, _ in found:
            count[live] += 1
        counts = np.zeros(len(words), np.int64)
        counts[order] = count
        alone = {int(i): self.encode(words[i]) for i in wide}
        for i, ids in alone.items():
            counts[i] = len(ids)
        start = np.cumsum(counts) - counts
        out = np.zeros(int(counts.sum()), np.int32)
        for back, (live, token) in enumerate(found, 1):
            out[start[order[live]] + count[live] - back] = token
        for i, ids in alone.items():
            out[start[i] : start[i] + len(ids)] = ids
        return out, counts

    def _hop_many(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        to = self._next[state, byte]
        new = np.flatnonzero(to < 0)
        if len(new):
            for s, b in {(int(s), int(b)) for s, b in zip(state[new], byte[new])}:
                hop = self._grow(s, b)
                while hop >= len(self._next) or s >= len(self._next):
                    self._next = np.concatenate([self._next, np.full_like(self._next, -1)])
                    self._ends = np.concatenate([self._ends, np.full_like(self._ends, -1)])
                self._next[s, b] = hop
                whole = [t for t, _ in self._whole[hop]]
                if len(whole) > self._ends.shape[1]:
                    self._ends = np.hstack([self._ends, np.full((len(self._ends), len(whole)), -1, np.int32)])
                self._ends[hop, : len(whole)] = whole
            to = self._next[state, byte]
        return to

    def _fit_many(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        """``fits`` of each pair where both are tokens; answers stay in a table of fixed size, one pair a slot."""
        pair = before.astype(np.int64) << 20 | token
        slot = (pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _PAIRS.bit_length() + 1)).astype(np.int64)
        fit = self._pair_fits[slot]
        new = np.flatnonzero((self._pair[slot] != pair) & (before >= 0) & (token >= 0))
        if len(new):
            kind, at = np.unique(pair[new], return_inverse=True)
            made = np.array([self.fits(p >> 20, p & 0xFFFFF) for p in kind.tolist()], bool)
            fit[new] = made[at]
            self._pair[slot[new]], self._pair_fits[slot[new]] = pair[new], fit[new]
        return fit

    def _back(self, last: list[int], k: int, out: list[int], at: int) -> None:
        """Insert at ``at`` of ``out`` the tokens that lead up to place ``k``."""
        chain_ = []
        while k > 0:
            chain_.append(last[k])
            k -= len(self.token[last[k]])
        out[at:at] = chain_[::-1]

    def _settle(self, last: list[int], out: list[int], longest: int) -> int:
        """Emit what all open readings agree on; returns how many bytes are done with."""
        starts = range(len(last) - 1 - longest, len(last))  # any token still to come begins at one of these
        paths = []
        for k in starts:
            path = {k}
            while k > 0:
                k -= len(self.token[last[k]])
                path.add(k)
            paths.append(path)
        k = max(set.intersection(*paths))
        self._back(last, k, out, len(out))
        settled = last[k]
        del last[:k]
        last[0] = settled if k else last[0]
        return k


class Joined:
    """Byte strings by number, joined for whole arrays of numbers."""

    def __init__(self, parts: list[bytes]):
        self.flat = np.frombuffer(b"".join(parts), np.uint8)
        self.size = np.array([len(p) for p in parts], np.int64)
        self.start = np.cumsum(self.size) - self.size

    def of(self, numbers: np.ndarray) -> bytes:
        size = self.size[numbers]
        ends = np.cumsum(size)
        shift = np.repeat(self.start[numbers] - ends + size, size)
        shift += np.arange(len(shift))
        return self.flat[shift].tobytes()


class Codec:
    """Whole texts to ids and back."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.words = regex.compile(pattern)
        self.machine = Transducer(ranks)
        self.token = self.machine.token
        self.known = PieceTable(self._words, np.int32)
        self.table = PieceTable(self._pieces, np.int32)

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.machine.encode_many([w.encode("utf-8", "surrogatepass") for w in words])

    def _pieces(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.known.gather([self.words.findall(piece_of(k)) for k in keys])

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text."""
        return encode_texts(self.table, texts)

    def forget(self) -> None:
        """Give back the tables of pieces; the machine stays."""
        self.known.forget()
        self.table.forget()


def decode_stream(token: Joined, chunks: Iterable[list[int]], errors: str = "replace") -> Iterator[str]:
    """Text of each chunk of ids as far as its characters are complete; the rest comes with a later one."""
    state = codecs.getincrementaldecoder("utf-8")(errors)
    for ids in chunks:
        yield state.decode(token.of(np.asarray(ids, np.int64)))
    yield state.decode(b"", True)


def decoded_bytes(token: Joined, ids: np.ndarray, chunk: int = 4096) -> Iterator[bytes]:
    """The bytes of ``ids`` in runs of whole characters; bytes that are no UTF-8 come through as they are."""
    for text in decode_stream(token, (ids[i : i + chunk] for i in range(0, len(ids), chunk)), "surrogateescape"):
        yield text.encode("utf-8", "surrogateescape")


@lru_cache(maxsize=2)
def _codec(content: bytes, pattern: str) -> Codec:
    return Codec(read_ranks(content), pattern)


@lru_cache(maxsize=2)
def _tokens(content: bytes) -> Joined:
    ranks = read_ranks(content)
    parts = [b""] * (max(ranks.values()) + 1)
    for word, rank in ranks.items():
        parts[rank] = word
    return Joined(parts)


def _drop_tables() -> None:
    _codec.cache_clear()
    _tokens.cache_clear()


def read_vocabulary(path: str) -> bytes:
    """The vocabulary file (a megabyte or so), read where the job is written and shipped with it."""
    with open(path, "rb") as f:
        return f.read()


def _lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if rows else [], kind))


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, text_col: str = "text", ids_col: str = "ids", check_col: str | None = None) -> DataFrame:
    """``docs`` with the ids of each whole text as an array in ``ids_col``.

    ``vocabulary``: path of a file of base64 tokens and ranks; ``pattern``: how a text
    is cut into words, each encoded by itself.  No special tokens.  Null or empty text:
    no ids.  Repeated rows: each encoded.  An old column ``ids_col`` is replaced; other
    columns stay as they are.  With ``check_col`` the ids are decoded again, and the column
    says whether that gave the text.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    docs = docs.drop(ids_col, *([check_col] if check_col else []))
    at = docs.columns.index(text_col)
    added = [T.StructField(ids_col, T.ArrayType(T.IntegerType()))] + ([T.StructField(check_col, T.BooleanType())] if check_col else [])

    @tidy("bpe", _drop_tables)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shipped.value, pattern)
        token = _tokens(shipped.value) if check_col else None
        for b in batches:
            texts = b.column(at).to_pylist()
            ids = list(codec.encode(texts))
            same = [b"".join(decoded_bytes(token, i)) == (t or "").encode() for i, t in zip(ids, texts)] if check_col else []
            del texts
            out = [*b.columns, _lists(ids, pa.int32()), *([pa.array(same, pa.bool_())] if check_col else [])]
            yield pa.RecordBatch.from_arrays(out, [*b.schema.names, *(f.name for f in added)])
        codec.forget()

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))


def decode_documents(rows: DataFrame, vocabulary: str, ids_col: str = "ids", text_col: str = "text", chunk: int = 4096) -> DataFrame:
    """``rows`` with the text of their ids in ``text_col``, decoded in chunks of ids.

    Null ids: null text.  Bytes that are no UTF-8 become U+FFFD.  An old column
    ``text_col`` is replaced.
    """
    shipped = rows.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    rows = rows.drop(text_col)
    at = rows.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = _tokens(shipped.value)
        for b in batches:
            texts = [
                None if ids is None else "".join(decode_stream(token, (ids[i : i + chunk] for i in range(0, len(ids), chunk))))
                for ids in b.column(at).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, text_col])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(text_col, T.StringType())]))


def digests(rows: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of encoded rows; the bytes come from the ids alone, through the streaming decoder."""
    import hashlib

    shipped = rows.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    sha = lambda x: hashlib.sha256(x).hexdigest()

    @tidy("bpe", _drop_tables)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = _tokens(shipped.value)
        number = Joined([b"%d " % i for i in range(len(token.size))])
        for b in batches:
            n, a, d = [], [], []
            for ids in b.column(1):
                ids = ids.values.to_numpy() if ids.is_valid else np.empty(0, np.int32)
                n.append(len(ids))
                a.append(sha(number.of(ids)[:-1]))
                back = hashlib.sha256()
                for part in decoded_bytes(token, ids):
                    back.update(part)
                d.append(back.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    picked = rows.select(F.col(id_col).cast("long").alias("doc_id"), ids_col)
    return picked.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
