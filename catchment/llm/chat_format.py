"""Conversations as training windows: turn-aligned spans under a token budget, with a loss mask.

A window is a run of whole turns.  It repeats the conversation's system turn and the last
turns before the run, as far as ``history`` tokens go; prefix sums of turn tokens say how
many new turns then fit into ``budget``.  The loss mask covers the texts of new assistant
turns only, so every such text is a target once.

Turns are marked by control strings.  Where a text holds one, a backslash goes in after its
first sign (and another one where there are backslashes already), which ``unescape`` takes
out again: no text can end a turn or open one.

A conversation is cut into segments of ``SEGMENT`` bytes by running totals over its turns,
so a conversation that holds most rows is packed by many tasks.  The system turn and the
turns that a later segment may repeat are sent along.  Rows of a segment stream through a
task in order; a task holds one window and its history.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..operators.running import running_totals
from ..session import materialize

BUDGET, HISTORY = 1024, 256
#: Bytes of a conversation that one task packs.
SEGMENT = 1 << 20
#: Counted for each turn besides its text, for its marks.
_MARKS = 16
_COUNTED = 256

# The template's control strings; other roles are named in [TURN name] ... [/TURN].
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
_CONTROL = r"(?:/?s>|</?SYS>>|/?INST\]|/?TURN)"
_HIDE = re.compile(r"([<\[]\\*)(?=%s)" % _CONTROL)
_SHOW = re.compile(r"([<\[]\\*)\\(?=%s)" % _CONTROL)
_OPEN = re.compile(r"<<SYS>>|\[INST\]|<s>|\[TURN( [^\]]*)?\]")
_ROLE_OF = {marks[0]: role for role, marks in MARKS.items()}

WINDOWS = (
    "conv_id long, segment long, window int, text string, loss array<struct<start:int,end:int>>, repeated int, turns int, tokens int, over_budget boolean, whole boolean"
)


def escape(text: str) -> str:
    return _HIDE.sub(r"\1\\", text)


def unescape(text: str) -> str:
    return _SHOW.sub(r"\1", text)


def marks(role: str | None) -> tuple[str, str]:
    if role in MARKS:
        return MARKS[role]
    return ("[TURN]" if role is None else f"[TURN {quote(role, safe='')}]"), "[/TURN]"


def parse_window(text: str) -> list[tuple[str | None, int, int]]:
    """(role, start and end of the escaped text) of every turn of a formatted window."""
    out, at = [], 0
    while at < len(text):
        m = _OPEN.match(text, at)
        if not m:
            raise ValueError(f"no turn opens at {at}")
        if m[0] in _ROLE_OF:
            role, close = _ROLE_OF[m[0]], MARKS[_ROLE_OF[m[0]]][1]
        else:
            role, close = None if m[1] is None else unquote(m[1][1:]), "[/TURN]"
        end = text.index(close, m.end())
        out.append((role, m.end(), end))
        at = end + len(close)
    return out


class _Packer:
    """Turns of one segment in order -> windows; holds the current window and what may be repeated."""

    def __init__(self, key: tuple, budget: int, history: int) -> None:
        self.key, self.budget, self.history = key, budget, history
        self.system: tuple | None = None  # retained by every window
        self.turns: list[tuple] = []  # (role, body, tokens)
        self.ends: list[int] = []  # running tokens up to and with each turn
        self.begun = 0  # running tokens before the first turn kept
        self.first = 0  # place of the window's first new turn
        self.windows = 0

    def add(self, turn: tuple, carried: bool) -> Iterator[tuple]:
        """``carried``: the turn belongs to the segment before and may only be repeated."""
        new = len(self.turns) - self.first
        upto = self.ends[-1] if self.ends else self.begun
        if carried:
            self._push(turn, upto)
            self.first = len(self.turns)
            return
        if new and self._before() + upto - self._start(self.first) + turn[2] > self.budget:
            yield self._window(False)
            self.first = len(self.turns)
        self._push(turn, upto)
        if len(self.turns) - self.first == 1:
            self._choose_history()

    def _push(self, turn: tuple, upto: int) -> None:
        self.turns.append(turn)
        self.ends.append(upto + turn[2])

    def _start(self, i: int) -> int:
        return self.ends[i - 1] if i else self.begun

    def _choose_history(self) -> None:
        """Keep the latest turns within ``history`` tokens that leave room for the first new turn."""
        here = self._start(self.first)
        room = min(self.history, self.budget - (self.system[2] if self.system else 0) - self.turns[self.first][2])
        starts = [self._start(i) for i in range(self.first + 1)]
        lo = bisect_left(starts, here - max(room, 0)) if room > 0 else self.first
        self.begun = starts[lo]
        del self.turns[:lo], self.ends[:lo]
        self.first -= lo

    def _before(self) -> int:
        """Tokens of the window that are repeated."""
        return (self.system[2] if self.system else 0) + self._start(self.first) - self.begun

    def close(self, whole: bool) -> Iterator[tuple]:
        if len(self.turns) > self.first:
            yield self._window(whole and not self.windows)

    def _window(self, whole: bool) -> tuple:
        shown = ([self.system] if self.system else []) + self.turns
        repeated = len(shown) - (len(self.turns) - self.first)
        text, at, loss = [], 0, []
        for i, (role, body, _) in enumerate(shown):
            a, z = marks(role)
            text += [a, body, z]
            if i >= repeated and role == "assistant" and body:
                loss.append({"start": at + len(a), "end": at + len(a) + len(body)})
            at += len(a) + len(body) + len(z)
        tokens = self._before() + self.ends[-1] - self._start(self.first)
        out = (*self.key, self.windows, "".join(text), loss, repeated, len(shown) - repeated, tokens, tokens > self.budget, whole)
        if not self.windows and not self.system and self.key[1] == 0 and self.turns[0][0] == "system":
            self.system, self.begun = self.turns.pop(0), self.ends.pop(0)  # from now on retained, not history
        self.windows += 1
        return out


def _pack(vocabulary: str, budget: int, history: int):
    """Sorted rows (conv_id, segment, part, turn, role, text, split) -> windows.

    ``part``: 0 system turn sent along, 1 turn of the segment before, 2 turn of the segment;
    ``split``: the conversation has several segments.
    """

    def counter():
        from tokenizers import Tokenizer

        tok = Tokenizer.from_str(vocabulary)
        tok.encode_special_tokens = True
        return lambda texts: [len(e.ids) for e in tok.encode_batch_fast(texts, add_special_tokens=False)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        count, now, split, out = None, None, False, []
        for b in batches:
            count = count or counter()
            for lo in range(0, b.num_rows, _COUNTED):
                rows = b.slice(lo, _COUNTED).to_pylist()
                bodies = [escape(r["text"] or "") for r in rows]
                costs = count(["".join((marks(r["role"])[0], body, marks(r["role"])[1])) for r, body in zip(rows, bodies)])
                for r, body, cost in zip(rows, bodies, costs):
                    key, turn = (r["conv_id"], r["segment"]), (r["role"], body, cost)
                    if now is None or now.key != key:
                        if now is not None:
                            out += now.close(not split)
                        now, split = _Packer(key, budget, history), r["split"]
                    if r["part"] == 0:
                        now.system = turn
                    else:
                        out += now.add(turn, r["part"] == 1)
                if out:
                    yield _batch(out)
                    out = []
        if now is not None:
            yield _batch([*now.close(not split)])

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_()]
    names = [c.split()[0] for c in re.split(r", (?=\w+ )", WINDOWS)]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def _segments(d: DataFrame, large: DataFrame, history: int) -> DataFrame:
    """Rows of large conversations with the segments where they are packed or repeated."""
    key = ["c", "n", "t"]
    least = F.lit(-(2**63))
    big = d.join(large, d.conv_id.eqNullSafe(large.large), "left_semi").withColumns(
        {"c": F.coalesce("conv_id", F.lit(0)), "n": F.col("conv_id").isNull(), "t": F.coalesce("turn", least)}
    )
    turns = running_totals(big.groupBy(*key).agg(F.sum("bytes").alias("bytes")), ["c", "n"], "t", ["bytes"], width=100_000.0, levels=4)
    turns = turns.select(*key, "cum_bytes", F.floor((F.col("cum_bytes") - F.col("bytes")) / SEGMENT).alias("segment"))
    one = Window.partitionBy("c", "n", "segment")  # no more rows than SEGMENT / _MARKS
    turns = turns.select(
        *key, "segment", F.row_number().over(one.orderBy(F.desc("t"))).alias("back"), F.floor(F.max("cum_bytes").over(one) / SEGMENT).alias("following")
    )
    turns = materialize(turns, "turns")
    placed = big.join(turns, key)
    own = placed.withColumn("part", F.lit(2))
    carried = placed.where((F.col("back") <= history) & (F.col("following") > F.col("segment"))).withColumns({"segment": F.col("following"), "part": F.lit(1)})
    leads = big.groupBy("c", "n").agg(F.min(F.struct("turn", "role", "text")).alias("lead")).where("lead.role = 'system'")
    sent = turns.where("segment > 0").select("c", "n", "segment").distinct().join(leads, ["c", "n"])
    sent = sent.select(F.when(~F.col("n"), F.col("c")).alias("conv_id"), "segment", F.lit(0).alias("part"), "lead.turn", "lead.role", "lead.text")
    cols = ["conv_id", "segment", "part", "turn", "role", "text"]
    return own.select(cols).unionByName(carried.select(cols)).unionByName(sent).withColumn("split", F.lit(True))


def format_conversations(rows: DataFrame, vocabulary: str, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Windows of conversations: (conv_id, segment, window, text, loss, repeated, turns, tokens, over_budget, whole).

    ``rows``: conv_id, turn, role, text.  ``vocabulary`` is a file of the tokenizers library;
    tokens are counted turn by turn, marks included.  Turns go by ``turn``, then role and text.
    ``loss`` holds code point ranges of ``text``; ``repeated`` says how many leading turns stood
    in a window before, ``whole`` that the window holds its whole conversation.  A turn is never
    cut: one that does not fit makes a window of its own, ``over_budget``.

    Null text: empty.  Null or unknown role: a turn under its own name, never a target.  Null
    conv_id: one conversation.  Null turn: first.  Repeated rows: a turn each.  Empty table: no
    rows.  Other columns are ignored.
    """
    d = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    sized = d.withColumn("bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + F.coalesce(F.octet_length("role"), F.lit(0)) + _MARKS)
    large = sized.groupBy(F.col("conv_id").alias("large")).agg(F.sum("bytes").alias("b")).where(F.col("b") > SEGMENT).select("large")
    large = materialize(large, "large_conversations")
    single = [F.lit(0).cast("long").alias("segment"), F.lit(2).alias("part"), "turn", "role", "text", F.lit(False).alias("split")]
    if large.isEmpty():
        parts = d.select("conv_id", *single)
    else:
        parts = d.join(large, d.conv_id.eqNullSafe(large.large), "left_anti").select("conv_id", *single)
        parts = parts.unionByName(_segments(sized, large, history))
    order = ["conv_id", "segment", "part", "turn", "role", "text"]
    with open(vocabulary, encoding="utf-8") as f:
        packed = _pack(f.read(), budget, history)
    return parts.repartition("conv_id", "segment").sortWithinPartitions(*order).mapInArrow(packed, WINDOWS)


def read_turns(text: str, repeated: int = 0) -> list[tuple[str | None, str]]:
    """(role, text) of a window's new turns."""
    return [(role, unescape(text[a:z])) for role, a, z in parse_window(text)[repeated:]]


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of a conversation in order -> what its turns and its loss mask hold, window by window."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    now: list | None = None

    def done() -> tuple:
        return now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]

    for b in batches:
        out = []
        for r in b.to_pylist():
            if now is None or now[0] != r["conv_id"]:
                if now is not None:
                    out.append(done())
                now = [r["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text in read_turns(r["text"], r["repeated"]):
                now[1] += 1
                now[2].update(f"{role or ''}\n{text}\n".encode())
            for span in r["loss"]:
                text = unescape(r["text"][span["start"] : span["end"]])
                now[3] += len(text)
                now[4].update(text.encode())
            now[5] += len(r["text"])
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names)
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(done(), kinds)], names)


def conversation_digests(windows: DataFrame) -> DataFrame:
    """One row a conversation, read back from its windows.

    A conversation that fits one window is read where it lies.  The windows of the others
    stream in order through one task each conversation, as a digest of all turns needs
    them one after the other; the task holds one window.
    """
    kind = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    cols = ["conv_id", "segment", "window", "text", "loss", "repeated"]
    alone = windows.where("whole").select(cols).mapInArrow(_digest, kind)
    rest = windows.where("not whole").select(cols).repartition("conv_id").sortWithinPartitions("conv_id", "segment", "window")
    return alone.unionByName(rest.mapInArrow(_digest, kind))
