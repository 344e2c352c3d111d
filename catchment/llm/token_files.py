"""Token ids as Arrow stream files of equal-length sequences.

A file is an Arrow IPC stream; each record batch holds ``ids`` (fixed-size list of
unsigned integers, 16 bits if the vocabulary allows) and ``mask`` (fixed-size list of
booleans, false where a sequence is only filled up).  Rows are the file's documents
one after the other, cut into sequences of ``length`` ids, so a sequence lies at a known
place and a memory-mapped file is read without copying.

Documents are range partitioned by id; a task encodes its range and writes one file,
so files in order hold all documents in order.  Each try of a task writes under a name
of its own, and only files named in the returned index count.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..session import materialize
from .bytewords import ByteTable, encode_plain
from .pieces import is_plain

LENGTH = 2048
#: Sequences in a record batch.
ROWS = 256


def read_tokenizer(path: str) -> str:
    """The tokenizer file (a megabyte or two), read where the job is written and shipped with it."""
    with open(path, encoding="utf-8") as f:
        return f.read()


class Encoder:
    """Ids of whole texts, by the tokenizers library; each kind of piece is encoded once."""

    def __init__(self, content: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks share the cores already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.width = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 2**16 else "<u4")
        self.table = ByteTable(self._pieces, self.width)
        self.feed = self._ids("\n")
        assert len(self.feed) == 1, "the vocabulary must hold the line feed"

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.width) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces go to the library as lines of one text, as a line feed between them is a match of its own."""
        full = np.array([p != "\x02" for p in pieces])  # the mark of an empty text
        fed = np.array([p[0] == "\n" for p in pieces])
        counts = np.zeros(len(pieces), np.int64)
        ids, counts[full] = self._lines([p[1:] if p[0] in "\x02\n" else p for p in pieces if p != "\x02"], fed[full])
        return ids, counts

    def _lines(self, lines: list[str], fed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not lines:
            return np.empty(0, self.width), np.empty(0, np.int64)
        flat = np.array(self._ids("\n" + "\n".join(lines)), self.width)
        is_feed = flat == self.feed[0]
        at = np.flatnonzero(is_feed)  # one before each line, kept where the piece has it
        counts = np.diff(np.append(at, len(flat))) - ~fed
        is_feed[at[fed]] = False
        return flat[~is_feed], counts

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text, of type ``width``."""
        return encode_plain(self.table, texts, lambda t: not is_plain(t), self._whole)


@lru_cache(maxsize=2)
def _encoder(content: str) -> Encoder:
    return Encoder(content)


def file_schema(width: np.dtype, length: int) -> pa.Schema:
    kind = pa.uint16() if width.itemsize == 2 else pa.uint32()
    return pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])


class Writer:
    """Packs ids into sequences and batches of one stream file."""

    def __init__(self, sink, width: np.dtype, length: int):
        self.schema, self.width, self.length = file_schema(width, length), width, length
        self.out = pa.ipc.new_stream(sink, self.schema)
        self.parts: list[bytes] = []
        self.held = 0

    def add(self, ids: bytes) -> None:
        self.parts.append(ids)
        self.held += len(ids)
        if self.held >= ROWS * self.length * self.width.itemsize:
            self._batches(last=False)

    def _batches(self, last: bool) -> None:
        flat = np.frombuffer(b"".join(self.parts), self.width)
        full = ROWS * self.length
        while len(flat) >= full or (last and len(flat)):
            part, flat = flat[:full], flat[full:]
            rows = -(-len(part) // self.length)
            ids = np.zeros(rows * self.length, self.width)
            ids[: len(part)] = part
            mask = np.arange(len(ids)) < len(part)
            arrays = [
                pa.FixedSizeListArray.from_arrays(pa.array(x, t.value_type), self.length)
                for x, t in zip((ids, mask), self.schema.types)
            ]
            self.out.write_batch(pa.RecordBatch.from_arrays(arrays, schema=self.schema))
        self.parts, self.held = [flat.tobytes()], len(flat) * self.width.itemsize

    def close(self) -> None:
        self._batches(last=True)
        self.out.close()


class TokenFile:
    """Random access to a stream file; local files are memory-mapped and not copied."""

    def __init__(self, uri: str):
        fs, path = pafs.FileSystem.from_uri(uri)
        source = pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)
        self.batches = list(pa.ipc.open_stream(source))
        self.first = np.cumsum([0, *[b.num_rows for b in self.batches]])

    def __len__(self) -> int:
        return int(self.first[-1])

    def sequence(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """Ids (a view of the file) and mask of sequence ``i``."""
        k = int(np.searchsorted(self.first, i, "right")) - 1
        ids, mask = (self.batches[k].column(c)[i - int(self.first[k])].values for c in (0, 1))
        return ids.to_numpy(), mask

    def read(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from place ``start`` on, across sequences; a view if they lie in one batch."""
        length = self.batches[0].schema.field(0).type.list_size if self.batches else 1
        out = []
        while n > 0:
            k = int(np.searchsorted(self.first, start // length, "right")) - 1
            flat = self.batches[k].column(0).flatten()
            at = start - int(self.first[k]) * length
            part = flat.slice(at, min(n, len(flat) - at)).to_numpy()
            out.append(part)
            start, n = start + len(part), n - len(part)
        return out[0] if len(out) == 1 else np.concatenate(out or [np.empty(0, np.uint16)])


def _open_sink(uri: str):
    fs, path = pafs.FileSystem.from_uri(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return fs.open_output_stream(path)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts, write them in ascending id order, return the index.

    ``folder``: a shared folder (URI or path); ``tokenizer``: path of a tokenizer file;
    ``end_id`` follows each document.  Index: doc_id, file, part (files in order), place
    (ids before it in its file), start (ids before it in all files), n_tokens.

    Null or empty text: the end id alone.  Null ids come first.  Repeated rows are written
    each, in an order of their own.  Empty table: no files, no rows.  Other columns are
    ignored.
    """
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    folder = folder.replace("file:/", "file:///", 1) if folder.startswith("file:/") and not folder.startswith("file://") else folder
    shipped = docs.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = _encoder(shipped.value), TaskContext.get().partitionId()
        end = np.array([end_id], enc.width).tobytes()
        uri, sink, writer, place = f"{folder}/{part:06d}-{uuid.uuid4().hex}.arrows", None, None, 0
        for b in batches:
            counts = []
            for ids in enc.encode(b.column(1).to_pylist()):
                ids = ids.tobytes() + end
                if writer is None:
                    sink = _open_sink(uri)
                    writer = Writer(sink, enc.width, length)
                writer.add(ids)
                counts.append(len(ids) // enc.width.itemsize)
            if counts:
                places = place + np.cumsum([0, *counts])
                place = int(places[-1])
                n = len(counts)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([uri] * n), pa.array([part] * n, pa.int32()), pa.array(places[:-1], pa.int64()), pa.array(counts, pa.int64())],
                    ["doc_id", "file", "part", "place", "n_tokens"],
                )
        if writer is not None:
            writer.close()
            sink.close()

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    d = d.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    index = materialize(d.mapInArrow(run, "doc_id long, file string, part int, place long, n_tokens long"), "token_index")
    totals = index.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row for each file
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    index = index.join(totals, "part")
    return index.select("doc_id", "file", "part", "place", (F.col("before") + F.col("place")).alias("start"), "n_tokens")


def read_documents(index: DataFrame) -> DataFrame:
    """``index`` with the ids of each document, read back from its file, as little-endian 32-bit bytes."""

    at = {c: i for i, c in enumerate(index.columns)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri, opened = None, None
        for b in batches:
            out = []
            for f, place, n in zip(*(b.column(at[c]).to_pylist() for c in ("file", "place", "n_tokens"))):
                if f != uri:
                    uri, opened = f, TokenFile(f)
                out.append(opened.read(place, n).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.large_binary()).cast(pa.binary())], [*b.schema.names, "ids"])

    return index.mapInArrow(run, T.StructType([*index.schema.fields, T.StructField("ids", T.BinaryType())]))


def stored(index: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the documents as the files hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri, opened = None, None
        for b in batches:
            n, crc = [], []
            for f, place, want in zip(*(b.column(c).to_pylist() for c in (1, 2, 4))):
                if f != uri:
                    uri, opened = f, TokenFile(f)
                ids = opened.read(place, want)
                n.append(len(ids))
                crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(3), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"]
            )

    picked = index.select("doc_id", "file", "place", "start", "n_tokens")
    return picked.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
