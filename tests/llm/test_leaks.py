import re

from catchment.llm import decontaminate as D
from catchment.llm.decontaminate import find_leaks

SF = "/root/testdata/sf0.01"
ITEM = "A train leaves Boston at 60 km per hour with 120 people. It stops after 3 hours and 40 people leave for London by bus."
OTHER = "A train leaves Paris at 80 miles per hour with 200 people. It stops after 5 hours and 30 people leave for Rome by bus."
TORN = "A train leaves Paris at 80 km per hour with 80 people. It stops after 80 hours and 80 people leave for Paris by bus."


def test_reparameterised_items_and_odd_rows(spark):
    items = spark.createDataFrame([(1, ITEM, "h"), (2, "small item", "h"), (3, "only five words are here", "h"), (4, None, "h"), (None, ITEM, "h"), (1, ITEM, "h")], "item_id long, text string, hash string")
    docs = [(1, "Before. " + OTHER + " after"), (2, ITEM), (2, ITEM), (3, TORN), (4, None), (5, ""), (6, "see: ONLY five words, are here"), (None, ITEM), (7, "word " * 30_000 + ITEM)]
    rows = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, pos int, h string")
    got = sorted((r.doc_id, r.item_id, r.n_matched, r.n_windows, r.verbatim) for r in find_leaks(rows, items).collect())
    n = got[0][3]
    assert [(d, i, v) for d, i, _, _, v in got] == [(1, 1, False), (2, 1, True), (6, 3, True), (7, 1, True)] and got[1][2] == n
    assert find_leaks(rows.where("false"), items).count() == 0 and find_leaks(rows, items.where("false")).count() == 0


def test_finds_all_planted_items(spark):
    plain = lambda s: " ".join(re.findall(r"\w+", (s or "").lower()))
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    want = {(d.doc_id, i.item_id) for i in items.collect() for d in docs.collect() if plain(i.text) and plain(i.text) in plain(d.text)}
    assert want and {(r.doc_id, r.item_id) for r in find_leaks(docs, items).collect()} == want


def test_items_of_few_words_or_few_literals(spark):
    texts = [
        "Who wrote Hamlet in 1600?", "Compute 12 * 7 + 3 - 4 / 2", "Paris", "small item",
        "In May 1912 Ernest Shackleton, Robert Scott and Roald Amundsen met Fridtjof Nansen in Oslo on 12 June 1913 with 40 kg.",
        "\u5c0f\u660e\u67093\u4e2a\u82f9\u679c\uff0c\u4ed6\u53c8\u4e70\u4e865\u4e2a\uff0c\u4e00\u5171\u6709\u591a\u5c11\u4e2a\u82f9\u679c\uff1f", "\u0e41\u0e21\u0e27\u0e01\u0e34\u0e19\u0e1b\u0e25\u0e32",
    ]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    docs = [(i, f"some words before {t} and after it" if t.isascii() else f"\u524d\u9762{t}\u540e\u9762") for i, t in enumerate(texts)]
    other = [(90, "Who wrote Faust in 1808?"), (91, "\u5c0f\u7ea2\u67097\u672c\u4e66\u3002"), (92, "Compute 12 * 7 + 3 - 4 / 5")]
    got = {(r.doc_id, r.item_id, r.share, r.verbatim) for r in find_leaks(spark.createDataFrame(docs + other, "doc_id long, text string"), items).collect()}
    assert got == {(i, i, 1.0, True) for i in range(len(texts))}


def test_opening_names_runs_and_shifts(spark):
    names = "Yesterday Alice met Boris near Kiev and Carla saw Dmitri with Elena in Rome while Frank took Greta from Oslo to Milan"
    slots = "We drove from Paris with 30 bags and then flew from Berlin with 40 boxes before we sailed from Lisbon with 50 crates to our home"
    parts = ["a small brown dog ran past the old mill", "where grey geese slept near some tall green reeds", "until rain fell upon every roof of that quiet town"]
    items = [(1, "Sarah bought 3 apples and sold 2 pears"), (2, slots), (3, names), (4, " ".join(parts))]
    moved = slots.replace("Paris", "New York").replace("30", "twenty five").replace("Berlin", "Los Angeles").replace("40", "one hundred").replace("Lisbon", "Santa Cruz")
    docs = [
        (1, "Note. Tom bought 5 apples and sold 4 pears"), (2, moved), (3, names.lower()), (4, f"{parts[0]} again {parts[1]} and so on {parts[2]}"),
        (5, "Tom bought 5 apples and sold 5 pears"), (6, " ".join([parts[2], "x", parts[1], "x", parts[0]])),
    ]
    frames = (spark.createDataFrame(x, f"{c} long, text string") for x, c in ((docs, "doc_id"), (items, "item_id")))
    got = {(r.doc_id, r.item_id): (r.share, r.verbatim) for r in find_leaks(*frames).collect()}
    assert set(got) == {(1, 1), (2, 2), (3, 3), (4, 4)}, got
    assert got[1, 1] == (1.0, False) and got[2, 2] == (1.0, False) and got[3, 3] == (1.0, True)


def _plain_entry(raw):
    """(word, kind, ends, breaks) of a raw word as plain expressions say it; none for signs alone."""
    word = D._EDGE.sub("", raw)
    low, ends = word.lower(), raw.rstrip("\"')]}")[-1:] in (".", "!", "?", ":")
    both = D._NUMBER_UNIT.fullmatch(low)
    if not word:
        return []
    if D._NUMBER.fullmatch(low) or D.NUMBER_WORDS.issuperset(low.split("-")):
        return [(low, D.NUMBER)], ends, ends or raw[-1] in ",;)]}"
    if both and (both[2] in D.UNITS or both[2] in "%°"):
        return [(both[1], D.NUMBER), (both[2], D.UNIT)], ends, ends or raw[-1] in ",;)]}"
    kind = D.UNIT if low in D.UNITS else D.NAME if word[0].isupper() and not word.isupper() else D.LITERAL
    return [(low, kind)], ends, ends or raw[-1] in ",;)]}"


def test_raw_words_are_read_once_and_as_the_expressions_say(monkeypatch):
    import random

    import xxhash

    r = random.Random(4)
    raw = ["".join(r.choice("abKm.,-'_(%\"9²5é°ÅΔ!") for _ in range(r.randint(1, 6))) for _ in range(4000)] + ["Twenty-one", "KM.", "5km,", "-3%", "--", "...", "half;"]
    words, made, entries = D.Words(), [], D.Words.entries
    monkeypatch.setattr(D, "_WORDS", words)
    monkeypatch.setattr(D.Words, "entries", lambda self, w: made.append(w) or entries(self, w))
    words.reset()
    text, _, value = D.templates([" ".join(raw), None, "-- ... " * 50 + " ".join(raw)])[D.PLAIN]
    assert sorted(made) == sorted(set(raw))
    want = []
    for w in raw:
        plain, got = _plain_entry(w), words.number[w]
        assert [words.kind[i] for i in got] == [k for _, k in (plain[0] if plain else [])], w
        want += [xxhash.xxh3_64_intdigest(low) for low, _ in (plain[0] if plain else [])]
        if plain:
            assert (bool(words.flags[got[-1]] & D._ENDS), bool(words.flags[got[-1]] & D._BREAKS)) == plain[1:], w
    assert value[text == 0].tolist() == value[text == 2].tolist() == want and not (text == 1).any()
