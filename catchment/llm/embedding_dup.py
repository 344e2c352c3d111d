"""Near-duplicate embeddings by Euclidean p-stable hashing.

Vectors are scaled to length one, so a least cosine is a greatest distance.  In each of
several tables a vector's bucket is the tuple of its quantised random projections;
vectors that share a label and a bucket in some table are compared exactly.  The number
of projections grows with the logarithm of the vectors of a label, that of tables so that
a pair just at the threshold is missed with probability ``MISS``.

Equal vectors collapse to one first.  Large buckets are cut into blocks that meet
pairwise, so a task holds two blocks.  A pair counts in the first table where it meets.
No pair is written: a block gives each vector's links and its least linked vector.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import materialize, release
from .graph import components
from .shingles import mix

MISS = 5e-4
WIDTH = 2.0
BLOCK = 512
#: Vectors unrelated to a given one that share its bucket in a table, about.
STRANGERS = 4.0


def _meet(distance: float) -> float:
    """Probability that two vectors at ``distance`` fall into one step of a random projection."""
    t = WIDTH / distance
    tail = 0.5 * math.erfc(t / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


def plan_tables(n: int, cosine: float) -> tuple[int, int]:
    """(projections, tables) for ``n`` vectors of a label; unrelated vectors are taken as orthogonal."""
    k = max(4, math.ceil(math.log(max(n, 2) / STRANGERS) / -math.log(_meet(math.sqrt(2)))))
    near = _meet(math.sqrt(max(2 - 2 * cosine, 1e-6))) ** k
    return k, max(1, math.ceil(math.log(MISS) / math.log1p(-near)))


def _usable(vector: list[float | None] | None) -> np.ndarray | None:
    if not vector or None in vector:
        return None
    v = np.array(vector, np.float64)
    return v if np.isfinite(v).all() and v.any() else None


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [_usable(v) if i is not None and k is not None else None for i, k, v in zip(*(b.column(c).to_pylist() for c in range(3)))]
        yield pa.RecordBatch.from_arrays(
            [*(b.column(c) for c in range(2)), pa.array([None if v is None else v.tobytes() for v in found], pa.binary())],
            ["vec_id", "label", "vector"],
        )


def _unit(raw: list[bytes]) -> np.ndarray:
    v = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # no overflow in the squares
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _bucket(k: int, tables: int):
    """(vec, label, n, vector) -> with the buckets of all tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            raw = b.column(3).to_pylist()
            keys = np.zeros((len(raw), tables), np.int64)
            sizes = np.array([len(r) for r in raw])
            for size in np.unique(sizes):
                if size not in planes:
                    rng = np.random.default_rng([7, int(size)])
                    planes[size] = rng.standard_normal((int(size) // 8, k * tables)), rng.uniform(0, WIDTH, k * tables)
                a, shift = planes[size]
                at = np.flatnonzero(sizes == size)
                step = np.floor((_unit([raw[i] for i in at]) @ a + shift) / WIDTH).astype(np.int64).astype(np.uint64)
                h = np.full((len(at), tables), size, np.uint64)  # vectors of different length never meet
                for j in range(k):
                    h = mix(h * np.uint64(0x9E3779B97F4A7C15) + step.reshape(len(at), tables, k)[:, :, j])
                keys[at] = h.astype(np.int64)
            packed = pa.array([row.tobytes() for row in keys], pa.binary())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(raw) + 1, dtype=np.int32) * tables), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, packed, lists], [*b.schema.names, "packed", "keys"])

    return run


def _block(rows: dict[str, list], table: int, crossed: bool, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """(links, least linked place) of every vector of a block or of two blocks that meet."""
    x, w = _unit(rows["vector"]), np.array(rows["n"], np.int64)
    linked = x @ x.T >= cosine
    np.fill_diagonal(linked, False)
    if crossed:
        side = np.array(rows["own"])
        linked &= side[:, None] != side[None, :]
    i, j = np.nonzero(linked)
    if len(i):
        keys = np.frombuffer(b"".join(rows["packed"]), np.int64).reshape(len(x), -1)
        before = np.zeros(len(i), bool)
        for t in range(table):  # met in an earlier table
            before |= keys[i, t] == keys[j, t]
        links = np.bincount(i[~before], w[j[~before]], len(x)).astype(np.int64)
    else:
        links = np.zeros(len(x), np.int64)
    root = np.arange(len(x))
    while len(i):
        new = root.copy()
        np.minimum.at(new, i, root[j])
        if (new == root).all():
            break
        root = new
    return links, root


def _compare(cosine: float):
    """Rows sorted by group -> (vec, links, root) of each vector of each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("vec", "own", "n", "vector", "packed")
        held: dict[str, list] = {c: [] for c in names}
        group, out = None, ([], [], [])

        def finish():
            if len(held["vec"]) > 1:
                order = np.argsort(held["vec"], kind="stable")
                rows = {c: [v[k] for k in order] for c, v in held.items()}
                links, root = _block(rows, group[0], group[3] != group[4], cosine)
                vec = np.array(rows["vec"], np.int64)
                seen = np.flatnonzero((links > 0) | (root != np.arange(len(root))))
                for o, v in zip(out, (vec[seen], links[seen], vec[root[seen]])):
                    o.append(v)
            for v in held.values():
                v.clear()

        def flush():
            arrays = [pa.array(np.concatenate([np.empty(0, np.int64), *o])) for o in out]
            for o in out:
                o.clear()
            return pa.RecordBatch.from_arrays(arrays, ["vec", "links", "root"])

        for b in batches:
            cols = {c: b.column(c).to_pylist() for c in (*names, "t", "label", "key", "bi", "bj")}
            for r, g in enumerate(zip(*(cols[c] for c in ("t", "label", "key", "bi", "bj")))):
                if g != group:
                    finish()
                    group = g
                for c in names:
                    held[c].append(cols[c][r])
            yield flush()
        finish()
        yield flush()

    return run


def near_embeddings(vectors: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Links between vectors of equal label with ``cosine`` or more: vec_id, n_links, component_id, kept.

    One row per input row; ``n_links`` counts other rows linked directly, ``component_id``
    is the least id reachable, ``kept`` = it is the row's own.  Vectors that are null,
    empty, zero or hold null or non-finite components, and such with null label, link
    with nothing.  Null id: no links, component null, kept.  Repeated rows are vectors of
    their own that link with each other.  Vectors of different length never link.  Empty
    table: no rows.  Other columns are ignored.
    """
    v = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("e")
    )
    rows = materialize(v.mapInArrow(_read, "vec_id long, label string, vector binary"), "vectors")
    single = rows.where("vector is not null").groupBy("label", "vector").agg(F.min("vec_id").alias("vec"), F.count("*").alias("n"))
    single = materialize(single.select("vec", "label", "n", "vector"), "single_vectors")
    most = single.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    k, tables = plan_tables(most, cosine)
    hashed = materialize(single.mapInArrow(_bucket(k, tables), "vec long, label string, n long, vector binary, packed binary, keys array<long>"), "bucketed")

    posts = hashed.select("vec", "label", F.posexplode("keys").alias("t", "key"))
    sizes = posts.groupBy("t", "label", "key").agg(F.count("*").alias("m")).where("m > 1")
    p = posts.join(sizes, ["t", "label", "key"]).withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int"))
    p = p.withColumn("own", F.pmod(F.xxhash64("vec"), "blocks").cast("int"))
    p = p.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    p = p.select("vec", "t", "label", "key", "own", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"))
    group = ["t", "label", "key", "bi", "bj"]
    p = p.join(hashed.select("vec", "label", "n", "vector", "packed"), ["vec", "label"]).repartition(*group).sortWithinPartitions(*group)
    found = materialize(p.mapInArrow(_compare(cosine), "vec long, links long, root long"), "found")
    links = found.groupBy("vec").agg(F.sum("links").alias("links"))
    comps = components(found.select(F.col("vec").alias("u"), F.col("root").alias("v")))
    release(hashed)
    of = single.join(links, "vec", "left").join(comps.select(F.col("node").alias("vec"), "component"), "vec", "left")
    of = of.select("label", "vector", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("_links"), F.coalesce("component", "vec").alias("_c"))
    out = rows.join(of, ["label", "vector"], "left")
    out = out.select("vec_id", F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("_c", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
