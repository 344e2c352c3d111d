"""Centroid clustering, importance resampling and chat formatting against plain statements of them."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

import public_tokenizers as P

from catchment.llm import centroids, chat_format as chat, importance

from .brute import lower

JSON = P.path("byte_bpe_50k.json")


def _lloyd(rows, k, rounds, dim, scale, seed):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    cs = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cs))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in kept]
        for j in range(len(cs)):
            own = [v for (_, v), a in zip(kept, at) if a == j]
            if own:
                cs[j] = [sum(col) // len(own) for col in zip(*own)]
    return sorted(((-1 if i is None else i, near(v)[1], near(v)[0]) for i, v in kept)), cs


def _vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, tile string")


def test_clustering_equals_plain_lloyd(spark):
    r = random.Random(5)
    rows = [(i, [r.choice([-1.5, 0.01, 0.5, 2.25]) + r.random() for _ in range(20)]) for i in range(300)]
    rows += [(7, rows[7][1]), (None, rows[3][1]), (900, None), (901, [1.0]), (902, [None] * 20), (903, [float("nan")] * 20), (904, [float("inf")] + [0.0] * 19), (905, [])]
    got = centroids.cluster_vectors(_vectors(spark, rows), k=5, rounds=3, dim=20, scale=8.0, seed=3)
    want, cs = _lloyd(rows, 5, 3, 20, 8.0, 3)
    assert sorted((-1 if a.vec_id is None else a.vec_id, a.cluster, a.distance) for a in got.assigned.collect()) == want
    out = centroids.inertia_and_digests(got).collect()
    text = {j: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for j, c in enumerate(cs)}
    per = {j: sum(d for _, c, d in want if c == j) for j in range(5)}
    assert {(o.cluster, o.cluster_inertia, o.inertia, o.centroid_sha256) for o in out} == {(j, per[j], sum(per.values()), text[j]) for j in {c for _, c, _ in want}}


def test_clustering_with_slices_joined_by_block(spark, monkeypatch):
    r = random.Random(6)
    rows = [(i, [r.gauss(0, 1) for _ in range(33)]) for i in range(200)]
    monkeypatch.setattr(centroids, "BROADCAST_BYTES", 0)
    got = centroids.cluster_vectors(_vectors(spark, rows), k=4, rounds=2, dim=33)
    assert sorted((a.vec_id, a.cluster, a.distance) for a in got.assigned.collect()) == _lloyd(rows, 4, 2, 33, 64.0, 1)[0]


def test_clustering_of_few_and_far_vectors(spark):
    empty = centroids.inertia_and_digests(centroids.cluster_vectors(_vectors(spark, []), dim=2))
    assert empty.count() == 0
    rows = [(1, [0.0, 0.0]), (2, [1.0, 1.0]), (3, [1e300, 0.0])]
    got = {a.vec_id: (a.cluster, a.distance) for a in centroids.cluster_vectors(_vectors(spark, rows), k=16, dim=2).assigned.collect()}
    assert got[3] == (None, None) and got[1][1] == got[2][1] == 0 and got[1][0] != got[2][0]
    lone = centroids.cluster_vectors(_vectors(spark, rows[2:]), dim=2)
    assert [(o.vec_id, o.cluster, o.inertia) for o in centroids.inertia_and_digests(lone).collect()] == [(3, None, None)]
    same = centroids.cluster_vectors(_vectors(spark, [(i, [0.5, -0.5]) for i in range(40)]), k=3, dim=2)
    assert {(a.cluster, a.distance) for a in same.assigned.collect()} == {(0, 0)}


_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _features(text, width):
    ws = _WORD.findall(lower(text or ""))
    return len(ws), [" ".join(ws[i : i + n]) for n in range(1, width + 1) for i in range(len(ws) - n + 1)]


def _texts(seed, n):
    r = random.Random(seed)
    out = ["".join(r.choices(["a", "B ", "c1", " ", "\x01", ",", "é", "中", "\n", "the "], k=r.randint(0, 60))) for _ in range(n)]
    return [*out, None, "", " ,;\x7f", "x" * 300 + " y " + "é" * 90, "x" * 300, "w " * 3000, out[0]]


def test_composed_crcs_equal_those_of_joined_words():
    texts = _texts(1, 300)
    flat, features, counts = importance.feature_buckets(texts, width=3)
    end = 0
    for t, n, w in zip(texts, features, counts):
        words, fs = _features(t, 3)
        assert (words, len(fs)) == (w, n)
        assert sorted(zlib.crc32(f.encode()) % 10_000 for f in fs) == sorted(flat[end : end + n].tolist())
        end += n


def _resample(docs, target, percent, least, seed, m):
    held = {i: _features(t, 2) for i, (_, t) in enumerate(docs)}
    bucket = lambda f: zlib.crc32(f.encode()) % m
    s, t = [0] * m, [0] * m
    for _, fs in held.values():
        for f in fs:
            s[bucket(f)] += 1
    for x in target:
        for f in _features(x, 2)[1]:
            t[bucket(f)] += 1
    s_all, t_all = sum(s) + m, sum(t) + m
    gain = [math.floor(1000 * math.log((b + 1) * s_all / ((a + 1) * t_all))) for a, b in zip(s, t)]
    out = []
    for k, (i, _) in enumerate(docs):
        w, fs = held[k]
        weight = sum(gain[bucket(f)] for f in fs) // len(fs) if fs else 0
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))
        out.append([i, len(fs), weight, score, None, w])
    may = sorted((o for o in out if o[0] is not None and o[5] >= least), key=lambda o: (-o[3], o[0], o[2], o[1]))
    for rank, o in enumerate(may[: percent * len(may) // 100], 1):
        o[4] = rank
    return sorted((tuple(o[:5]) for o in out), key=repr)


def test_resampling_equals_plain_statement(spark):
    texts = _texts(2, 200)
    docs = [*((i * 3 - 50, t) for i, t in enumerate(texts)), (None, "a b c d e f"), (4, "c1 c1 c1 c1"), (4, "c1 c1 c1 c1")]
    target = ["the c1 the c1", None, "é a a"]
    d = spark.createDataFrame([(i, t, 1, "z") for i, t in docs], "doc_id long, text string, rank int, score string")
    b = spark.createDataFrame([(1, t) for t in target], "item_id long, text string")
    for percent, least, m in ((25, 3, 10_000), (100, 0, 7), (50, 2, 70_000)):
        got = importance.resample(d, b, percent=percent, least_words=least, buckets=m, seed=9)
        assert sorted((tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr) == _resample(docs, target, percent, least, 9, m)
    assert importance.resample(d.where("false"), b).count() == 0
    none = importance.resample(d, b.where("false"), percent=25, least_words=3)
    assert sorted((tuple(r) for r in none.collect()), key=repr) == _resample(docs, [], 25, 3, 7, 10_000)


CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[TURN]", "[/TURN]", "[TURN user]", "<", "[", "\\", "/", "s>", "SYS>>", "é", "a b ", "\n", "😀"]


def test_escaping_is_reversible_and_hides_controls():
    r = random.Random(3)
    for _ in range(4000):
        t = "".join(r.choices(CONTROL, k=r.randint(0, 8)))
        e = chat.escape(t)
        assert chat.unescape(e) == t
        assert not re.search(r"</?s>|\[/?INST\]|<</?SYS>>|\[/?TURN", e)


def _conversations(spark, rows):
    return spark.createDataFrame([(*r, "x", 5) for r in rows], "conv_id long, turn long, role string, text string, window string, part int")


def _want(rows):
    out = {}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")
    for r in sorted(rows, key=key):
        out.setdefault(r[0], []).append((r[2], r[3] or ""))
    return {
        c: (len(ts), hashlib.sha256("".join(f"{a or ''}\n{t}\n" for a, t in ts).encode()).hexdigest(), "".join(t for a, t in ts if a == "assistant"))
        for c, ts in out.items()
    }


def _check(spark, rows, budget, history):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(JSON)
    tok.encode_special_tokens = True
    windows = chat.format_conversations(_conversations(spark, rows), JSON, budget, history).collect()
    want = _want(rows)
    by = {}
    for w in sorted(windows, key=lambda w: (w.segment, w.window)):
        by.setdefault(w.conv_id, []).append(w)
    assert set(by) == set(want)
    for c, ws in by.items():
        turns, loss, lead = [], "", None
        for n, w in enumerate(ws):
            shown = chat.parse_window(w.text)
            cost = sum(len(tok.encode("".join((chat.marks(r)[0], w.text[a:z], chat.marks(r)[1])), add_special_tokens=False).ids) for r, a, z in shown)
            assert cost == w.tokens and w.over_budget == (cost > budget) and len(shown) == w.repeated + w.turns and w.turns > 0
            texts = chat.read_turns(w.text)
            if n == 0:
                lead = texts[0] if texts[0][0] == "system" else None
                assert w.repeated == 0
            elif lead:
                assert texts[0] == lead and w.repeated >= 1
            again = texts[(1 if lead and n else 0) : w.repeated]
            assert again == (turns[-len(again) :] if again else [])  # what is repeated came just before
            assert not w.over_budget or w.turns == 1
            turns += texts[w.repeated :]
            new = [(a, z) for r, a, z in shown[w.repeated :] if r == "assistant" and z > a]
            assert [(s.start, s.end) for s in w.loss] == new
            loss += "".join(chat.unescape(w.text[a:z]) for a, z in new)
            assert w.whole == (len(ws) == 1 and w.segment == 0 and all(x.segment == 0 for x in ws))
        assert (len(turns), hashlib.sha256("".join(f"{a or ''}\n{t}\n" for a, t in turns).encode()).hexdigest(), loss) == want[c]
    table = spark.createDataFrame(windows, chat.WINDOWS) if windows else chat.format_conversations(_conversations(spark, rows), JSON)
    got = {r.conv_id: r for r in chat.conversation_digests(table).collect()}
    assert set(got) == set(want)
    for c, (n, turns, loss) in want.items():
        r = got[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (n, turns, len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == sum(len(w.text) for w in by[c])
    return by


def _chat_rows(seed, convs, most):
    r = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(r.randint(1, most)):
            role = "system" if t == 0 and r.random() < 0.5 else r.choice(["user", "assistant", "assistant", "system", "tool/[x]", None, ""])
            rows.append((c, t, role, r.choice([None, "", "word " * r.randint(1, 60), "".join(r.choices(CONTROL, k=12))])))
    return rows


def test_windows_hold_every_turn_once(spark):
    rows = _chat_rows(4, 40, 30)
    rows += [(None, 1, "user", "no id"), (None, None, "assistant", "no turn"), (3, 2, "user", "tie"), (3, 2, "user", "tie"), (99, 0, "system", "s " * 500), (99, 1, "user", "u"), (99, 2, "assistant", "</s>")]
    rows += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]"), (98, 0, "assistant", "long " * 20_000), (98, 1, "assistant", "b")]
    by = _check(spark, rows, 100, 40)
    assert any(len(ws) > 3 and ws[3].repeated > 1 for ws in by.values())


def test_large_conversations_are_cut_into_segments(spark, monkeypatch):
    monkeypatch.setattr(chat, "SEGMENT", 400)
    rows = _chat_rows(5, 6, 80) + [(None, t, "user" if t % 2 else "assistant", f"turn {t} " * 9) for t in range(40)]
    rows += [(50, None, "system", "be brief"), (50, None, "user", "x"), *((50, t, "assistant", "w " * (1 + t % 200)) for t in range(120))]
    by = _check(spark, rows, 90, 30)
    later = [w for ws in by.values() for w in ws if w.segment > 0 and w.window == 0]
    assert len(later) > 20 and any(w.repeated > 1 for w in later)


def test_no_conversations(spark):
    assert chat.format_conversations(_conversations(spark, []), JSON).count() == 0
    assert chat.conversation_digests(chat.format_conversations(_conversations(spark, []), JSON)).count() == 0
