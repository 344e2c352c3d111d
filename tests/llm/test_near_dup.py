import random

import pytest

from catchment.llm import graph, line_dedup, near_dup

from . import brute


def _texts(seed, n=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdEFé", k=3))
    out = []
    for i in range(n):
        if i % 3 == 0 or not out:
            t = [word() for _ in range(r.randint(1, 60))]
        else:  # a copy with a few words changed
            t = r.choice(out).split()
            for _ in range(r.randint(0, 3)):
                t[r.randrange(len(t))] = word()
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize("small", [48, 2])
def test_near_duplicates_match_brute_force(spark, monkeypatch, small):
    """Also with every posting taken as a large one, in blocks of four."""
    monkeypatch.setattr(near_dup, "SMALL", small)
    if small == 2:
        monkeypatch.setattr(near_dup, "BLOCK", 4)
    docs = [(i * 7 % 211, t) for i, t in enumerate(_texts(small))] + [(900, None), (901, ""), (902, " \t\n"), (903, "one"), (904, "ONE ")]
    rows = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, sig string, comp int")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(rows).collect()}
    assert got == brute.near_duplicates(docs)


def test_near_duplicates_on_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, long), (2, long), (3, "a b c"), (3, "a b c"), (None, "a b c"), (4, "a b c")]
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 1, 0, True), (1, 29_996, 1, True), (2, 29_996, 1, False), (3, 1, 3, True), (3, 1, 3, True), (4, 1, 3, False)]
    assert near_dup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 100), (None, 3), (60, 50)], "u long, v long")
    got = {r.node: r.component for r in graph.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 60: 50}


LINES = ["a line that is long enough", "  A LINE that is long enough\t", "short", "", "another line, also long enough", "ünïcode line with twenty", "x" * 40]


def _line_docs(seed):
    r = random.Random(seed)
    docs = [(i, "\n".join(r.choices(LINES, k=r.randint(1, 70)))) for i in range(12)]
    return docs + [(20, None), (21, ""), (22, "own line of this document"), (23, "\n".join(LINES[:1] * 500)), (None, LINES[0]), (5, docs[5][1])]


@pytest.mark.parametrize("frequent", [True, False])
def test_line_dedup_matches_brute_force(spark, monkeypatch, frequent):
    """By the way of frequent keys, which in so small a table are all, and by range partitions."""
    if not frequent:
        monkeypatch.setattr(line_dedup, "_frequent", lambda p: p.sparkSession.createDataFrame([], "h1 long"))
    docs = _line_docs(3)
    rows = spark.createDataFrame([(*d, "k", 5) for d in docs], "doc_id long, text string, kept string, _words int")
    out = line_dedup.drop_repeated_lines(rows)
    got = sorted((str(r.doc.doc_id), r.n_lines, r.n_dropped, r.kept) for r in out.collect())
    assert got == sorted((str(d), n, g, k) for d, n, g, k in brute.drop_lines(docs))
    assert any(g for _, _, g, _ in got) and out.first().doc.kept == "k"


def test_line_dedup_of_nothing(spark):
    assert line_dedup.drop_repeated_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
