"""MinHash near-duplicates by a signature-coordinate inverted join.

Each distinct shingle set is posted under (coordinate, minimum) pairs.  Two sets
of similarity s share K*s of K coordinates on average; pairs below ``MATCHES``
shared ones are not looked at.  A set needs MATCHES coordinates that some other
set shares, so of its c shared coordinates only the c - MATCHES + 1 rarest are
posted (prefix): two sets with enough matches must meet in one of them.  Sets with
fewer are skipped.  Every surviving pair is confirmed on the full sets.

Copies collapse to one representative first.  Within a posting every member is
compared with the least one; after joining what is linked, only members of
different components are still compared: pair by pair in small postings, by blocks
of documents against blocks where postings are large.  Nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..session import materialize, release
from .graph import components
from .memory import tidy
from .shingles import forget, shingle_set

K = 64
#: A pair at similarity 0.8 has fewer matches than this with probability 6e-6.
MATCHES = 36
#: Postings up to this size are compared pair by pair, larger ones by blocks.
SMALL = 48
BLOCK = 512
#: Pairs of a set that share one copy of it when they are confirmed.
SHARED = 1024
_COLUMNS = 2048


def _multipliers() -> np.ndarray:
    return np.random.default_rng(20240607).integers(0, 2**63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(s: np.ndarray) -> np.ndarray:
    """K minima of a non-empty hash set, high halves of multiplied hashes."""
    a, out = _multipliers(), np.full(K, 2**64 - 1, np.uint64)
    for i in range(0, len(s), 4096):
        part = s[i : i + 4096]
        out = np.minimum(out, (part[None, :] * a[:, None]).min(axis=1))
    return (out >> np.uint64(32)).astype("<u4")


def _sign(width: int):
    @tidy("near_dup", forget)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ns, hs, sg = [], [], []
            for t in b.column(1):
                s = shingle_set(t.as_py(), width)
                ns.append(len(s))
                hs.append(xxhash.xxh3_128_digest(s.tobytes()))
                sg.append(signature(s).tobytes() if len(s) else b"")
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(ns, pa.int64()), pa.array(hs, pa.binary()), pa.array(sg, pa.binary())],
                ["doc_id", "n_shingles", "set_hash", "sig"],
            )
        forget()

    return run


def _sets(width: int):
    @tidy("near_dup", forget)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t.as_py(), width).tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], ["doc", "set"])
        forget()

    return run


@tidy("near_dup")
def _post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    coord = np.arange(K, dtype=np.int64) << np.int64(32)
    for b in batches:
        if b.num_rows:
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), "<u4").reshape(-1, K)
            key = (sig.astype(np.int64) + coord).ravel()
            doc = np.repeat(b.column(0).to_numpy(zero_copy_only=False), K)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(doc)], ["key", "doc"])


@tidy("near_dup")
def _enough_matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), "<u4").reshape(-1, K) for c in ("sa", "sb"))
            yield b.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= MATCHES))


def _confirm(percent: int):
    """Rows (a, part, b, set) in order, where the row without b holds the set of a -> links (a, b)."""

    @tidy("near_dup")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, np.empty(0, np.uint64)
        for batch in batches:
            us, vs = [], []
            for a, b, raw in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                other = np.frombuffer(raw.as_buffer(), np.uint64)
                if b is None:
                    at, own = a, other.copy()
                    continue
                assert a == at
                both = len(np.intersect1d(own, other, assume_unique=True))
                if 100 * both >= percent * (len(own) + len(other) - both):
                    us.append(a)
                    vs.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["a", "b"])

    return run


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, by products over slices of the shingles both sides hold."""
    owner = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (left, right)]
    flat = [np.concatenate(x) if x else np.empty(0, np.uint64) for x in (left, right)]
    vocab = np.intersect1d(*flat)
    out = np.zeros((len(left), len(right)), np.float32)
    at = [np.searchsorted(vocab, f) for f in flat]
    for lo in range(0, len(vocab), _COLUMNS):
        hot = []
        for f, p, o, n in zip(flat, at, owner, (len(left), len(right))):
            pick = np.nonzero((p >= lo) & (p < min(lo + _COLUMNS, len(vocab))))[0]
            pick = pick[vocab[p[pick]] == f[pick]]
            m = np.zeros((n, _COLUMNS), np.float32)
            m[o[pick], p[pick] - lo] = 1
            hot.append(m)
        out += hot[0] @ hot[1].T
    return out


def _block_links(percent: int):
    def run(group: pa.Table) -> pa.Table:
        side = group.column("side").to_numpy()
        part = [group.filter(pa.array(side == k)) for k in (0, 1)]
        doc, comp = ([p.column(c).to_numpy() for p in part] for c in ("doc", "comp"))
        sets = [[np.frombuffer(v, np.uint64) for v in p.column("set").to_pylist()] for p in part]
        u, v = [], []
        if len(doc[0]) and len(doc[1]):
            both = shared_counts(*sets).astype(np.int64)
            size = [np.array([len(s) for s in x], np.int64) for x in sets]
            ok = 100 * both >= percent * (size[0][:, None] + size[1][None, :] - both)
            ok &= comp[0][:, None] != comp[1][None, :]
            for i in np.nonzero(ok.any(axis=1))[0]:
                js = np.nonzero(ok[i])[0]
                js = js[np.unique(comp[1][js], return_index=True)[1]]  # one link to each component is enough
                u += [doc[0][i]] * len(js)
                v += doc[1][js].tolist()
        return pa.table({"a": pa.array(u, pa.int64()), "b": pa.array(v, pa.int64())})

    return run


def _links(pairs: DataFrame, cand: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of distinct (a, b) pairs those with enough matches and similarity."""
    s = cand.select("doc", "n", "sig")
    for c in ("a", "b"):
        pairs = pairs.join(s.select(F.col("doc").alias(c), F.col("n").alias(f"n{c}"), F.col("sig").alias(f"s{c}")), c)
    # sets whose sizes differ by more cannot be that similar
    pairs = pairs.where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    pairs = pairs.select("a", "b", "sa", "sb").mapInArrow(_enough_matches, "a long, b long")
    # the set of a goes once to every ``SHARED`` of its pairs, not to each of them
    pairs = materialize(pairs, "matched")
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / SHARED).cast("int").alias("parts"))
    sets = sets.select("doc", "set")
    many = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part"), "b")
    many = many.join(sets.withColumnRenamed("doc", "b"), "b").select("a", "part", "b", "set")
    once = parts.join(sets.withColumnRenamed("doc", "a"), "a")
    once = once.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"), "set")
    rows = many.unionByName(once).repartition("a", "part").sortWithinPartitions("a", "part", F.asc_nulls_first("b"))
    found = materialize(rows.mapInArrow(_confirm(percent), "a long, b long").distinct(), "confirmed")
    release(pairs)
    return found


def _with_component(df: DataFrame, comps: DataFrame) -> DataFrame:
    c = comps.select(F.col("node").alias("doc"), F.col("component").alias("_c"))
    return df.join(c, "doc", "left").withColumn("comp", F.coalesce("_c", "doc")).drop("_c")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents whose shingle sets have similarity of ``percent`` or more.

    Words are parted by ASCII white space with A-Z lower-cased; a set holds the
    distinct ``width``-word shingles of the whole text, or the whole sequence if it
    is shorter.  Returns one row per input row: doc_id, n_shingles, component_id (the
    least doc_id reachable), kept (doc_id = component_id).

    Null or wordless text: 0 shingles, linked with nothing.  Null id: takes no part,
    component null, kept.  Repeated rows: each gives a row with the same answer; rows
    that share an id are one document.  Empty table: no rows.  Other columns are ignored.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = materialize(
        d.mapInArrow(_sign(width), "doc_id long, n_shingles long, set_hash binary, sig binary"), "signed"
    )
    reps = materialize(
        signed.where("n_shingles > 0 and doc_id is not null")
        .groupBy("n_shingles", "set_hash")
        .agg(F.min("doc_id").alias("doc"), F.first("sig").alias("sig")),
        "representatives",
    )
    posted = reps.select("doc", "sig").mapInArrow(_post, "key long, doc long")
    common = posted.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    prefix = (
        posted.join(common, "key")
        .groupBy("doc")
        .agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("ks"))  # K at most for each set
        .where(F.size("ks") >= MATCHES)
        .select("doc", F.expr(f"transform(slice(ks, 1, size(ks) - {MATCHES - 1}), k -> k.key)").alias("ks"))
    )
    cand = materialize(
        prefix.join(reps.select("doc", F.col("n_shingles").alias("n"), "sig"), "doc").select("doc", "n", "sig", "ks"),
        "candidates",
    )
    ids = cand.select(F.col("doc").alias("doc_id")).distinct()
    sets = materialize(
        d.join(ids, "doc_id", "left_semi").mapInArrow(_sets(width), "doc long, set binary").where("length(set) > 0"), "sets"
    )

    # every member of a posting against its least one
    member = cand.select("doc", F.explode("ks").alias("key"))
    least = member.groupBy("key").agg(F.min("doc").alias("a"))
    star = member.join(least, "key").where("doc <> a").select("a", F.col("doc").alias("b")).distinct()
    links = _links(star, cand, sets, percent)
    comps = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))

    # members of different components that meet in a posting
    m = materialize(_with_component(member, comps), "members")
    open_keys = (
        m.groupBy("key").agg(F.count("*").alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    )
    m = m.join(open_keys.select("key", "m"), "key")
    small = m.where(f"m <= {SMALL}").select("key", "doc", "comp")
    x, y = (small.select("key", F.col("doc").alias(c), F.col("comp").alias(f"c{c}")) for c in "ab")
    pairs = x.join(y, (x.key == y.key) & (x.a < y.b) & (x.ca != y.cb)).select("a", "b").distinct()
    pairs = pairs.join(star.select(F.col("a"), F.col("b")), ["a", "b"], "left_anti")
    more = _links(pairs, cand, sets, percent)
    blocks = _large_postings(m.where(f"m > {SMALL}").select("key", "doc", "comp"), sets, percent)
    links2 = materialize(more.unionByName(blocks), "more_links")

    joined = comps.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(
        links2.select(F.col("a").alias("u"), F.col("b").alias("v"))
    )
    final = components(joined)
    release(sets, cand, links, m, links2)
    classes = reps.select("n_shingles", "set_hash", "doc").join(final.withColumnRenamed("node", "doc"), "doc", "left")
    out = signed.select("doc_id", "n_shingles", "set_hash").join(
        classes.select("n_shingles", "set_hash", F.coalesce("component", "doc").alias("_c")), ["n_shingles", "set_hash"], "left"
    )
    comp = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("_c", "doc_id"))
    return out.select("doc_id", "n_shingles", comp.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def _large_postings(m: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components inside large postings.

    Postings that share documents form a cluster.  Its documents outside the largest
    component meet all its documents, block by block, so a task holds two blocks.
    """
    least = m.groupBy("key").agg(F.min("doc").alias("v"))
    cluster = components(m.join(least, "key").select(F.col("doc").alias("u"), "v"))
    h = m.select("doc", "comp").distinct()
    h = h.join(cluster.withColumnRenamed("node", "doc"), "doc", "left")
    h = materialize(h.select("doc", "comp", F.coalesce("component", "doc").alias("cluster")), "clustered")
    per = h.groupBy("cluster", "comp").agg(F.count("*").alias("n")).groupBy("cluster")
    per = per.agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("n"))
    count = lambda n: F.ceil(F.expr(n) / BLOCK).cast("int")
    h = h.join(per, "cluster").select("cluster", "doc", "comp", "top", count("n").alias("nr"), count("n - top.n").alias("nl"))
    block = lambda n: F.pmod(F.xxhash64("doc"), F.col(n)).cast("int")
    left = h.where("comp <> top.comp").select(
        "cluster", block("nl").alias("lb"), F.explode(F.sequence(F.lit(0), F.col("nr") - 1)).alias("rb"), "doc", "comp", F.lit(0).alias("side")
    )
    right = h.where("nl > 0").select(
        "cluster", F.explode(F.sequence(F.lit(0), F.col("nl") - 1)).alias("lb"), block("nr").alias("rb"), "doc", "comp", F.lit(1).alias("side")
    )
    both = left.unionByName(right).join(sets, "doc")
    return both.groupBy("cluster", "lb", "rb").applyInArrow(_block_links(percent), "a long, b long").distinct()
