import base64

import public_tokenizers as P
import tiktoken

import corpus_pipeline as C
from catchment.llm.decontaminate import find_leaks
from catchment.llm.queries import toxic_lexicon
from catchment.llm.toxicity import score_texts

from . import brute

SF = "/root/testdata/sf0.001"


def test_pipeline_matches_plain_stages(spark):
    source, labels, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    docs = [(r.doc_id, r.text) for r in source.collect()]
    score = score_texts([t for _, t in docs], toxic_lexicon(source, labels))
    docs = [d for d, s in zip(docs, score) if s < C.TOXIC_FROM]
    docs = [(i, k) for i, _, gone, k in brute.drop_lines(docs) if not gone or k.strip()]
    near = brute.near_duplicates(docs)
    docs = [d for d in docs if near[d[0]][2]]
    leaks = {r.doc_id for r in find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
    docs = [d for d in docs if d[0] not in leaks]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    done = C.run(spark, SF).collect()
    assert all(r.intact and r.n_tokens == len(r.ids) for r in done)
    got = {r.doc_id: r.ids for r in done}
    assert 0 < len(got) < source.count() and got == {i: own.encode_ordinary(t or "") for i, t in docs}


def test_stages_on_odd_rows(spark):
    names = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, "en", "s", 0), (2, "", None, None, None), (None, "text without id", "en", "s", 15), (3, "same text", "en", "s", 9), (3, "same text", "en", "s", 9)]
    for docs in (spark.createDataFrame(rows, names), spark.createDataFrame([], names)):
        kept = docs
        for name, stage in C.STAGES[:-1]:
            kept = stage(spark, kept, SF)
            assert kept.columns == docs.columns, name
        assert sorted(map(str, kept.collect())) == sorted(map(str, docs.collect()))
        assert C.STAGES[-1][1](spark, kept, SF).count() == docs.count()


def test_documents_left_with_blanks_go(spark):
    names = "doc_id long, text string, lang string, source string, n_chars long"
    line = "a line that stands in many documents"
    rest = ["\t", "\n\n", " \x0b\f\r", "own", ""]
    rows = [(i, f"{line}\n{r}", "en", "s", 0) for i, r in enumerate(rest)] + [(9, line, "en", "s", 0), (10, "\t", "en", "s", 1), (11, None, "en", "s", 0)]
    kept = {r.doc_id: r.text for r in C.line_dedup(spark, spark.createDataFrame(rows, names), SF).collect()}
    assert kept == {3: "own", 9: line, 10: "\t", 11: None}
