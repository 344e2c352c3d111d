import numpy as np
import pytest

from catchment.llm import embedding_dup as E

from . import brute

SCHEMA = "vec_id long, embedding array<float>, label int, links string"


def _rows(seed):
    r = np.random.default_rng(seed)
    out = []
    for c in range(12):
        mid = r.standard_normal(16)
        out += [(mid + r.standard_normal(16) * s).astype(np.float32).tolist() for s in r.choice([0.05, 0.2, 0.3], 6)]
    out += [out[0], out[0], [2 * x for x in out[1]]]
    rows = [(i, v, int(i % 5 == 0)) for i, v in enumerate(out)]
    bad = [None, [], [0.0] * 16, [None] + [1.0] * 15, [float("nan")] + [1.0] * 15, [float("inf")] * 16]
    return rows + [(200 + i, v, 1) for i, v in enumerate(bad)] + [(300, out[0], None), (301, out[0][:8], 0), (302, out[0][:8], 0)]


@pytest.mark.parametrize("block", [512, 2])
def test_links_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(E, "BLOCK", block)
    rows = _rows(block)
    got = {r.vec_id: (r.n_links, r.component_id) for r in E.near_embeddings(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)).collect()}
    assert got == brute.near_vectors([(i, k, v) for i, v, k in rows])


def test_odd_rows(spark):
    rows = [(1, [1.0, 0.0], 1, ""), (1, [1.0, 0.0], 1, ""), (None, [1.0, 0.0], 1, ""), (2, [1.0, 0.1], 1, "")]
    got = sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in E.near_embeddings(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(0, 0, 0, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)]
    assert E.near_embeddings(spark.createDataFrame([], SCHEMA)).count() == 0


def test_pairs_at_the_threshold_are_found():
    """The planned tables find nearly all pairs just at the threshold."""
    k, tables = E.plan_tables(5000, 0.93)
    r = np.random.default_rng(1)
    a = r.standard_normal((400, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = r.standard_normal((400, 64))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = 0.93 * a + np.sqrt(1 - 0.93**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    planes, shift = r.standard_normal((64, k * tables)), r.uniform(0, E.WIDTH, k * tables)
    same = (np.floor((a @ planes + shift) / E.WIDTH) == np.floor((b @ planes + shift) / E.WIDTH)).reshape(400, tables, k).all(axis=2).any(axis=1)
    assert same.mean() >= 0.99
