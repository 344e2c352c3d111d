"""Lloyd clustering of whole-number vectors, sharded by dimension.

Vectors are turned into whole numbers, packed by the hundreds into tiles and cut into
column blocks.  A round is three Spark steps:

1. a task of one column block works out the exact partial squared distances of its tiles
   to the centroids' slice of that block;
2. the partial distances of a tile are added over its blocks, and the least sum names each
   vector's centroid (ties: the smaller number);
3. each block adds up its own columns per centroid and makes its next slice.

No task sees whole centroids, and no vector is moved: per round and vector only
``blocks * k`` partial distances and one label are shuffled.  Slices are tables of
``k * dim`` numbers, broadcast below ``BROADCAST_BYTES`` and joined on (block, salt)
beyond.  Sums run as partial aggregates, so a centroid that holds most vectors is no hot
key.  All arithmetic is in 64-bit integers and therefore the same in any order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import materialize, release

TILE = 1024
#: Columns of a block.
WIDTH = 16
#: Components must be smaller than this, so that any squared distance of 64 columns fits 64 bits.
REACH = 2**27
#: Slices up to this size go to every task; larger ones only to the tasks of their block.
BROADCAST_BYTES = 32 << 20
_SALTS = 256
_TILES = "tile long, block int, vecs int, data binary"


@dataclass
class Clustering:
    """``assigned``: (vec_id, cluster, distance); ``centroids``: (cluster, block, width values)."""

    assigned: DataFrame
    centroids: DataFrame


def whole_numbers(vectors: DataFrame, dim: int, scale: float, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, data, exact): floor(scale * x) of every usable vector, as packed 64-bit integers.

    A usable vector has exactly ``dim`` components, none null or non-finite; others give no
    row.  A vector with a component of ``REACH`` or more cannot be compared exactly and comes
    with ``exact`` false and no data.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vec = b.column(1)
            right = pc.fill_null(pc.equal(pc.list_value_length(vec), dim), False)
            b = b.filter(right)
            flat = b.column(1).flatten()
            x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)  # nulls turn into NaN
            ok = np.isfinite(x).all(axis=1)
            x, ids = np.floor(scale * x[ok]), b.column(0).filter(pa.array(ok))
            near = (np.abs(x) < REACH).all(axis=1) if len(x) else np.empty(0, bool)
            rows = np.where(near[:, None], x, 0).astype("<i8")
            data = [r.tobytes() if good else None for r, good in zip(rows, near)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(data, pa.binary()), pa.array(near)], ["vec_id", "data", "exact"])

    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    return v.where(F.size("v") == dim).mapInArrow(run, "vec_id long, data binary, exact boolean")


def _blocks(dim: int) -> list[tuple[int, int, int]]:
    return [(b, lo, min(lo + WIDTH, dim)) for b, lo in enumerate(range(0, dim, WIDTH))]


def _tile(dim: int):
    """Rows of (vec_id, data) -> tiles: block -1 holds the ids, the others a slice of the columns each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, tiles = TaskContext.get().partitionId() << 32, 0
        for b in batches:
            for lo in range(0, b.num_rows, TILE):
                part = b.slice(lo, TILE)
                x = np.frombuffer(b"".join(part.column(1).to_pylist()), "<i8").reshape(-1, dim)
                known = part.column(0).is_valid().to_numpy(zero_copy_only=False)
                ids = part.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype("<i8")
                data = [ids.tobytes() + known.astype(np.uint8).tobytes()]
                data += [_packed(x[:, a:z]) for _, a, z in _blocks(dim)]
                n = len(data)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([base + tiles] * n, pa.int64()), pa.array(range(-1, n - 1), pa.int32()), pa.array([len(x)] * n, pa.int32()), pa.array(data, pa.binary())],
                    ["tile", "block", "vecs", "data"],
                )
                tiles += 1

    return run


def _packed(x: np.ndarray) -> bytes:
    """The narrowest of 16, 32 and 64 bits that holds all numbers, named by the first byte."""
    for size in (2, 4, 8):
        if size == 8 or not x.size or (np.abs(x) < 2 ** (8 * size - 1)).all():
            return bytes([size]) + np.ascontiguousarray(x, f"<i{size}").tobytes()
    raise AssertionError


def _unpacked(raw: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(raw, f"<i{raw[0]}", offset=1).reshape(rows, -1).astype(np.int64)


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tile, vecs, data, slice) -> (tile, vecs, partial squared distances to all centroids)."""
    for b in batches:
        out = []
        for n, data, cut in zip(*(b.column(c).to_pylist() for c in ("vecs", "data", "slice"))):
            x, c = _unpacked(data, n), np.array(cut, np.int64)
            d = np.empty((n, len(c)), np.int64)
            for k, row in enumerate(c):
                e = x - row
                d[:, k] = (e * e).sum(axis=1)
            out.append(_packed(d))
        yield pa.RecordBatch.from_arrays([b.column("tile"), b.column("vecs"), pa.array(out, pa.binary())], ["tile", "vecs", "part"])


def _nearest(tile: pa.Table) -> pa.Table:
    """All blocks of a tile -> its labels and distances; a tile has as many rows as blocks."""
    n = tile.column("vecs")[0].as_py()
    total = sum(_unpacked(p, n) for p in tile.column("part").to_pylist())
    label = total.argmin(axis=1)
    far = np.take_along_axis(total, label[:, None], axis=1)
    return pa.table({"tile": tile.column("tile").slice(0, 1), "labels": pa.array([_packed(label[:, None])], pa.binary()), "distances": pa.array([_packed(far)], pa.binary())})


def _column_sums(width: int, k: int):
    """(block, vecs, data, labels) -> (block, cluster, n, s0 ...), once a task for each block and centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        counts: dict[int, np.ndarray] = {}
        for b in batches:
            for block, n, data, labels in zip(*(b.column(c).to_pylist() for c in ("block", "vecs", "data", "labels"))):
                x, label = _unpacked(data, n), _unpacked(labels, n)[:, 0]
                s, m = sums.setdefault(block, np.zeros((k, width), np.int64)), counts.setdefault(block, np.zeros(k, np.int64))
                for j in range(x.shape[1]):
                    np.add.at(s[:, j], label, x[:, j])
                m += np.bincount(label, minlength=k)
        for block, s in sums.items():
            at = np.flatnonzero(counts[block])
            cols = [np.full(len(at), block, np.int32), at.astype(np.int32), counts[block][at], *(s[at, j] for j in range(width))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["block", "cluster", "n", *(f"s{j}" for j in range(width))])

    return run


def _with_slices(tiles: DataFrame, centroids: DataFrame, k: int, dim: int) -> DataFrame:
    """Each column block's tiles with the slice of that block."""
    slices = centroids.groupBy("block").agg(F.transform(F.sort_array(F.collect_list(F.struct("cluster", "at"))), lambda s: s["at"]).alias("slice"))
    cut = tiles.where("block >= 0")
    if k * dim * 8 <= BROADCAST_BYTES:
        return cut.join(F.broadcast(slices), "block")
    salt = F.pmod("tile", F.lit(_SALTS))
    return cut.withColumn("salt", salt).join(slices.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1)))), ["block", "salt"])


def _assign(tiles: DataFrame, centroids: DataFrame, k: int, dim: int) -> DataFrame:
    parts = _with_slices(tiles, centroids, k, dim).select("tile", "vecs", "data", "slice").mapInArrow(_partial, "tile long, vecs int, part binary")
    return parts.groupBy("tile").applyInArrow(_nearest, "tile long, labels binary, distances binary")


def _moved(tiles: DataFrame, labels: DataFrame, centroids: DataFrame, k: int) -> DataFrame:
    """The next centroids: floor of the mean of each column; centroids without vectors stay."""
    s = [f"s{j}" for j in range(WIDTH)]
    schema = "block int, cluster int, n long, " + ", ".join(f"{c} long" for c in s)
    rows = tiles.where("block >= 0").join(labels.select("tile", "labels"), "tile").select("block", "vecs", "data", "labels")
    sums = rows.mapInArrow(_column_sums(WIDTH, k), schema).groupBy("block", "cluster").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in s])
    mean = sums.select("block", "cluster", F.array(*[F.expr(f"({c} - pmod({c}, n)) div n") for c in s]).alias("new"))
    out = centroids.join(mean, ["block", "cluster"], "left")
    return out.select("cluster", "block", F.coalesce(F.expr("slice(new, 1, size(at))"), "at").alias("at"))


def first_centroids(numbers: DataFrame, k: int, seed: int) -> list[np.ndarray]:
    """The ``k`` vectors whose ids have the least sha256 of ``<seed>:<id>``, in that order.

    Vectors without id are not taken; equal ids are ordered by their numbers.
    """
    hashed = numbers.where("exact and vec_id is not null").select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h"), "data")
    return [np.frombuffer(r["data"], "<i8") for r in hashed.orderBy("h", "data").limit(k).collect()]


def cluster_vectors(
    vectors: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: float = 64.0, seed: int = 1, id_col: str = "vec_id", vec_col: str = "embedding"
) -> Clustering:
    """Lloyd's algorithm on floor(scale * x) for a fixed number of rounds and a last assignment.

    One row per usable vector.  Vectors that are null, of another length or hold null or
    non-finite components give none.  Null id: the vector takes part, but never as a first
    centroid.  Repeated rows: each counts and gives a row.  Fewer than ``k`` vectors: as many
    centroids as there are.  Components of ``REACH`` or more after scaling: the vector has a
    row with null cluster and distance and takes no part.  Empty table: no rows.  Other
    columns are ignored.
    """
    numbers = materialize(whole_numbers(vectors, dim, scale, id_col, vec_col), "whole_numbers")
    first = first_centroids(numbers, k, seed)
    rows = [(c, b, v[lo:hi].tolist()) for c, v in enumerate(first) for b, lo, hi in _blocks(dim)]
    centroids = vectors.sparkSession.createDataFrame(rows, "cluster int, block int, at array<long>")
    apart = numbers.where("not exact") if first else numbers
    far = apart.select("vec_id", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance"))
    if not first:
        return Clustering(far, centroids)
    k, centroids = len(first), materialize(centroids, "centroids")
    # ranges of (block, tile): nearly every task holds columns of one block
    tiles = materialize(numbers.where("exact").mapInArrow(_tile(dim), _TILES).repartitionByRange("block", "tile"), "tiles")
    for _ in range(rounds):
        labels = materialize(_assign(tiles, centroids, k, dim), "labels")
        centroids, last = materialize(_moved(tiles, labels, centroids, k), "centroids"), centroids
        release(labels, last)
    labels = materialize(_assign(tiles, centroids, k, dim), "labels")
    ids = tiles.where("block = -1").select("tile", "vecs", "data")
    assigned = materialize(ids.join(labels, "tile").mapInArrow(_unpack, "vec_id long, cluster int, distance long").unionByName(far), "assigned")
    release(numbers, tiles, labels)
    return Clustering(assigned, centroids)


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for n, data, labels, distances in zip(*(b.column(c).to_pylist() for c in ("vecs", "data", "labels", "distances"))):
            ids, known = np.frombuffer(data, "<i8", n), np.frombuffer(data, np.uint8, offset=8 * n).astype(bool)
            label, far = _unpacked(labels, n)[:, 0], _unpacked(distances, n)[:, 0]
            yield pa.RecordBatch.from_arrays([pa.array(ids, mask=~known), pa.array(label, pa.int32()), pa.array(far)], ["vec_id", "cluster", "distance"])


def inertia_and_digests(c: Clustering) -> DataFrame:
    """Every vector with its cluster's and the whole inertia and its centroid's sha256 (components joined by commas)."""
    per = c.assigned.where("cluster is not null").groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    whole = per.agg(F.sum("cluster_inertia")).first()[0]
    parts = F.sort_array(F.collect_list(F.struct("block", "at")))
    texts = c.centroids.groupBy("cluster").agg(F.array_join(F.flatten(F.transform(parts, lambda p: p["at"])), ",").alias("text"))
    # one row a centroid, as many as asked for
    facts = per.join(texts, "cluster").select("cluster", "cluster_inertia", F.lit(whole).cast("long").alias("inertia"), F.sha2("text", 256).alias("centroid_sha256"))
    out = c.assigned.join(F.broadcast(facts), "cluster", "left")
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
