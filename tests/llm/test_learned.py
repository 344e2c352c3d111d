import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from catchment.llm import gbt, language_id as L, quality, queries as Q, sampling, toxicity as T, url_filter as U

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def labels(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}


def test_flat_trees_walk_as_single_ones():
    r = np.random.default_rng(0)
    x = r.standard_normal((500, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    f = gbt.fit(x, y, trees=30, depth=3)
    z = np.full(len(x), f.start)
    for tree in range(len(f.leaf)):
        for i, row in enumerate(x):
            node = 0
            while node < 7:
                node = 2 * node + 1 + (row[f.feature[tree, node]] > f.threshold[tree, node])
            z[i] += f.leaf[tree, node - 7]
    assert np.allclose(f.predict(x), 1 / (1 + np.exp(-z)))
    assert ((f.predict(x) > 0.5) == y).mean() > 0.95
    assert len(f.predict(x[:0])) == 0 and np.allclose(gbt.fit(x[:3], np.ones(3)).predict(x[:2]), 0.8)


def _right(rows, labels, name, held_out):
    told = [(labels[r.doc_id][name], r) for r in rows if r.doc_id in labels and r.held_out == held_out]
    return np.mean([(r.score >= 0.5) == bool(y) for y, r in told])


def test_quality_on_held_out_labels(spark, labels):
    rows = Q.QUERIES["op2_quality"](spark, SF).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert _right(rows, labels, "quality", True) >= 0.95


def test_toxicity_on_held_out_labels(spark, labels):
    rows = Q.QUERIES["op5_toxicity"](spark, SF).collect()
    assert len(rows) == 1000 and _right(rows, labels, "toxic", True) >= 0.93


def test_language_on_held_out_documents(spark):
    want = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = Q.QUERIES["op4_language_id"](spark, SF).collect()
    assert len(rows) == 1000 and np.mean([r.lang_pred == want[r.doc_id] for r in rows if r.held_out]) >= 0.97


def test_sample_is_bounded_and_stable(spark):
    rows = spark.range(500).toDF("doc_id")
    a, b = (sorted(r.doc_id for r in sampling.bounded(x, 20, "doc_id").collect()) for x in (rows, rows.repartition(7)))
    assert a == b and len(a) == 20
    docs = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "doc_id long, text string")
    told = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, None), (None, 1), (9, 1)], "doc_id long, label int")
    got = {(r.doc_id, r.text, r.label) for r in sampling.labelled_texts(docs, told, "label", F.lit(True), 10).collect()}
    assert got == {(1, "a", 1), (2, None, 0)}


ODD = [(1, None), (2, ""), (3, "1 2 3 ..."), (4, "word " * 20_000), (5, "same"), (5, "same"), (None, "idiot")]
ODD_SCHEMA = "doc_id long, text string, score string, label int, lang_pred string"


def _odd(spark, rows=ODD):
    return spark.createDataFrame([(*r, "x", 3, "y") for r in rows], ODD_SCHEMA)


def test_scores_of_odd_rows(spark):
    forest = quality.learn_quality(spark.createDataFrame([(f"text number {i} " * (i % 7), i % 2) for i in range(60)] + [(None, 1), ("x", None)], "text string, label int"))
    lexicon = T.Lexicon((("idiot", 5.0),), T.EXCEPTIONS, (-3.0, 1.0, 0.5, 0.1))
    model = L.learn_languages(spark.createDataFrame([("the one word of the same thing", "en"), ("der eine und die andere sache", "de"), (None, "fr"), ("x", None)], "text string, lang string"), min_count=1)
    for fn in (lambda d: quality.score_quality(d, forest), lambda d: T.score_toxicity(d, lexicon), lambda d: L.identify_languages(d, model)):
        rows = fn(_odd(spark)).collect()
        assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
        assert len({r.score for r in rows if r.doc_id == 5}) == 1
        assert fn(_odd(spark, [])).count() == 0
    found = {r.doc_id: r for r in L.identify_languages(_odd(spark), model).collect()}
    assert all((found[i].lang_pred, found[i].score) == (L.UNKNOWN, 0.0) for i in (1, 2, 3)) and found[5].lang_pred == "en"
    kept = T.reject_toxic(_odd(spark), lexicon, 0.7)
    assert kept.columns == _odd(spark).columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 5, 5]


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([], "text string, label int, lang string, url string")
    assert T.score_toxicity(_odd(spark), T.learn_lexicon(none)).count() == len(ODD)
    assert quality.score_quality(_odd(spark), quality.learn_quality(none)).count() == len(ODD)
    assert {r.lang_pred for r in L.identify_languages(_odd(spark), L.learn_languages(none)).collect()} == {L.UNKNOWN}
    assert len(U.learn_urls(none).score(["http://a.b/c"])) == 1


def test_lexicon_folds_and_excepts():
    lex = T.Lexicon((("idiot", 5.0), ("trash", 4.0)), ("trash can",))
    hits = lambda t: [w for _, _, w in T.matches(t, lex)]
    assert hits("You 1D10T and ｉｄｉｏｔ and іdіоt, id\u00adiot") == [5.0] * 4
    assert hits("bigidiot") == [] and hits("idiotic!") == [5.0]
    assert hits("the trash can is full of trash") == [4.0] and hits("trash cannot") == [4.0]
    assert T.features("idiot", lex)[2] > T.features("idiot " + "word " * 400, lex)[2] > 0


def test_viterbi_is_the_best_path():
    r = np.random.default_rng(5)
    lengths = np.array([4, 0, 6, 1])
    scores = np.round(r.standard_normal((11, 3)) * 4, 3)
    got = L.viterbi(scores, lengths, switch=2.5)
    value = lambda p, s: sum(s[i, k] for i, k in enumerate(p)) - 2.5 * sum(a != b for a, b in zip(p, p[1:]))
    at = 0
    for n in lengths:
        s = scores[at : at + n]
        best = max((value(p, s) for p in itertools.product(range(3), repeat=n)), default=0)
        assert abs(value(got[at : at + n].tolist(), s) - best) < 1e-9
        at += n


def test_spans_and_scripts(spark):
    en, de, ru = "the cat sat on the mat with another cat ", "der hund und die katze sind nicht hier ", "кошка сидит на окне и смотрит "
    model = L.learn_languages(spark.createDataFrame([(en * 5, "en"), (de * 5, "de"), (ru * 5, "ru")], "text string, lang string"))
    docs = spark.createDataFrame([(1, en + de + ru), (2, None), (3, "中文")], "doc_id long, text string")
    spans = {r.doc_id: [(s.n_words, s.lang) for s in r.spans] for r in L.language_spans(docs, model).collect()}
    assert spans[1] == [(9, "en"), (8, "de"), (6, "ru")] and spans[2] == []


URLS = [
    "http://a.com/x", "HTTP://A.COM", "https://www.Example.COM/en/1?q#f", "https://example.com/en/", "http://m.example.com/en", "x://notnet/es/", "http://a.net/es/1",
    "http://net/fr/?", "no scheme", None, "", "a://b://c/d", "http://h?x/y", "http://h#/y", "http://xexample.com/en/", "http://ünï.org/Ü\nx",
]


def _plain(url):
    at = (url or "").find("://")
    if at < 0:
        return "", ""
    rest, host = url[at + 3 :], ""
    n = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    path = rest[n:]
    m = next((i for i, c in enumerate(path) if c in "?#"), len(path))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:n])
    return host, path[:m]


def test_urls_match_plain_rules(spark):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate([*URLS, URLS[0]])], "page_id long, url string, host string, rule string")
    got = {r.page_id: r for r in U.judge_urls(pages, Q.URL_RULES).collect()}
    assert len(got) == len(URLS) + 1
    for i, u in enumerate([*URLS, URLS[0]]):
        host, path = _plain(u)
        fit = [(len(r), r, v) for v, r in Q.URL_RULES for h, _, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        want = max(fit)[1:] if fit else (None, None)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, want[0])
        assert got[i].verdict == want[1] if fit else got[i].verdict in ("allow", "block")
    assert U.judge_urls(pages.where("false"), Q.URL_RULES).count() == 0


def test_urls_learn_from_labels(spark):
    rows = [(f"http://site{i}.example.org/en/{i}", 1) for i in range(80)] + [(f"http://win-{i}-cash-777.example.org/a/b/c/{i}?x=1&y=2&z=3", 0) for i in range(80)]
    model = U.learn_urls(spark.createDataFrame(rows, "url string, label int"))
    a, b = model.score(["http://other.example.org/en/5", "http://win-9-cash-777.example.org/a/b/c/7?x=2&y=1&z=9"])
    assert a > 0.8 and b < 0.2


def test_letters_of_all_planes(spark):
    model = L.learn_languages(spark.createDataFrame([("the one word", "en"), ("der eine und", "de")], "text string, lang string"), min_count=1)
    texts = ["\U00010414\U0001042f\U0001043b", "\U0001e922\U0001e923", "\U00020000\U00020001 \U0002a6d0", "😀 🂡"]
    lang, share = L.predict_texts(texts, model)
    assert all(x in ("en", "de") for x in lang[:3]) and min(share[:3]) > 0 and (lang[3], share[3]) == (L.UNKNOWN, 0.0)


def test_automaton_finds_what_a_plain_search_finds():
    import random

    r = random.Random(8)
    lex = T.Lexicon(tuple((w, float(i + 1)) for i, w in enumerate(("ab", "abc", "ba", "cab", "bb"))), ("ab ba", "cab b"))
    for _ in range(400):
        text = "".join(r.choices("aAbc 4ß.", k=r.randint(0, 25)))
        t = T.fold(text)
        starts = [i for i in range(len(t)) if not (i and t[i - 1].isalpha())]
        safe = [(i, i + len(p)) for p in lex.exceptions for i in starts if t.startswith(p, i) and not t[i + len(p) : i + len(p) + 1].isalpha()]
        want = sorted(
            (i, i + len(e), w) for e, w in lex.weights for i in starts if t.startswith(e, i) and not any(a <= i and i + len(e) <= z for a, z in safe)
        )
        assert sorted(T.matches(text, lex)) == want
