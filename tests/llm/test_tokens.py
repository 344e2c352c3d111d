import base64
import random
import zlib

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

import public_tokenizers as P
import tiktoken
from tokenizers import Tokenizer

from catchment.llm import bpe, bytewords, token_files
from catchment.llm.pieces import keys_of, piece_of

RANKS = P.path("byte_bpe_50k.tiktoken")
JSON = P.path("byte_bpe_50k.json")
BITS = ["a", "B", "1", " ", " ", "\n", "\t", "'s", "é", "!", "\u3000", "中", " 's", "\x85", "\x1c", "\xa0", "\x02", "the", ".", "\n\n", ")", "😀", "<|endoftext|>"]


def _texts(seed, n=400):
    r = random.Random(seed)
    out = ["".join(r.choices(BITS, k=r.randint(0, 14))) for _ in range(n)]
    return [*out, None, "", "x" * 5000, "ab" * 3000, "word " * 4000, "Ünïcode thétext,\nnext line; end."]


@pytest.fixture(scope="module")
def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pieces_join_to_the_text():
    for t in _texts(1):
        assert "".join(map(piece_of, keys_of(t))) == (t or "")


def test_transducer_equals_library(tik):
    codec = bpe.Codec(bpe.read_ranks(bpe.read_vocabulary(RANKS)), P.PATTERN)
    texts = _texts(2)
    for t, ids in zip(texts, codec.encode(texts)):
        assert ids.tolist() == tik.encode_ordinary(t or "")
    r = random.Random(3)
    words = [bytes(r.choices(b"abehinorst\xc3\xa9", k=r.randint(1, 12) if i else 70)) for i in range(3000)]
    want = [tik._core_bpe.encode_single_piece(w) for w in words]
    assert [codec.machine.encode(w) for w in words] == want
    ids, counts = codec.machine.encode_many(words)
    assert counts.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]


def test_streamed_decoding_waits_for_whole_characters(tik):
    ranks = bpe.read_ranks(bpe.read_vocabulary(RANKS))
    token = bpe.Joined(sorted(ranks, key=ranks.get))
    text = "né 中文 😀 end"
    parts = list(bpe.decode_stream(token, [[i] for i in tik.encode_ordinary(text)]))
    assert "".join(parts) == text and "" in parts and not any("\ufffd" in p for p in parts)
    assert "".join(bpe.decode_stream(token, [[ranks[b"\xc3"]]])) == "\ufffd"


def test_encode_and_decode_documents(spark, tik):
    texts = _texts(4, 60)
    rows = spark.createDataFrame([(i, t, "old", 7) for i, t in enumerate(texts)], "doc_id long, text string, ids string, n_tokens int")
    coded = bpe.encode_documents(rows, RANKS, P.PATTERN)
    got = {r.doc_id: r for r in coded.collect()}
    assert all(got[i].ids == tik.encode_ordinary(t or "") and got[i].n_tokens == 7 for i, t in enumerate(texts))
    back = bpe.decode_documents(coded, RANKS, chunk=3)
    assert all(r.text == (texts[r.doc_id] or "") for r in back.collect())
    empty = bpe.encode_documents(rows.where("false"), RANKS, P.PATTERN)
    assert empty.count() == 0 and bpe.digests(empty, RANKS).count() == 0


def test_token_files_hold_all_documents_in_order(spark, tmp_path):
    library = Tokenizer.from_file(JSON)
    library.encode_special_tokens = True
    texts = _texts(5, 80)
    rows = spark.createDataFrame([(900 - i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, start string, part int")
    index = token_files.write_token_files(rows, str(tmp_path / "tokens"), JSON, length=64)
    whole = {900 - i: [*library.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    start = 0
    found = {r.doc_id: r for r in token_files.stored(index).collect()}
    for d in sorted(whole):
        r = found[d]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(whole[d]), zlib.crc32(np.array(whole[d], "<u4").tobytes()))
        start += len(whole[d])
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in token_files.read_documents(index).collect()} == whole
    # random access to sequences and masks
    files = sorted({(r.part, r.file) for r in index.collect()})
    flat = []
    for _, f in files:
        tf = token_files.TokenFile(f)
        for i in range(len(tf)):
            ids, mask = tf.sequence(i)
            assert len(ids) == len(mask) == 64
            flat += ids[np.array(mask)].tolist()
            assert i == len(tf) - 1 or all(mask.to_pylist())
    assert flat == [x for d in sorted(whole) for x in whole[d]]


def test_token_files_of_odd_rows(spark, tmp_path):
    rows = spark.createDataFrame([(None, "b"), (1, "a"), (1, "a")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.start, r.n_tokens) for r in token_files.stored(token_files.write_token_files(rows, str(tmp_path / "t"), JSON)).collect())
    assert got == [(0, 0, 2), (1, 2, 2), (1, 4, 2)]
    assert token_files.stored(token_files.write_token_files(rows.where("false"), str(tmp_path / "u"), JSON)).count() == 0


def test_words_with_equal_hashes_keep_their_own_ids():
    morse = "a"
    while len(morse) < 2048:
        morse += morse.translate(str.maketrans("ab", "ba"))
    pair = ["abcdefgh" + morse, "abcdefgh" + morse.translate(str.maketrans("ab", "ba"))]
    raw = [np.frombuffer(("\x02" + t).encode(), np.uint8) for t in pair]
    hashed = [bytewords.hashes(r, np.array([0]), np.array([len(r)]))[0] for r in raw]
    assert hashed[0] == hashed[1]  # the hash alone cannot tell them apart
    library = Tokenizer.from_file(JSON)
    encoder = token_files.Encoder(open(JSON, encoding="utf-8").read())
    for texts in (pair, pair[::-1], [f"x {pair[0]} y {pair[1]}", pair[1], pair[0] + "c"]):
        got = [np.asarray(x).tolist() for x in encoder.encode(texts)]
        assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
