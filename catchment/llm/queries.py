"""The registered queries of this subpackage, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import materialize, new_path
from .bpe import digests, encode_documents
from .centroids import cluster_vectors, inertia_and_digests
from .chat_format import conversation_digests, format_conversations
from .decontaminate import find_leaks
from .embedding_dup import near_embeddings
from .importance import resample
from .language_id import identify_languages, learn_languages
from .line_dedup import LOWER, UPPER, drop_repeated_lines
from .near_dup import near_duplicates
from .quality import learn_quality, score_quality
from .sampling import bounded, id_remainder, labelled_texts
from .token_files import stored, write_token_files
from .toxicity import Lexicon, learn_lexicon, score_toxicity
from .url_filter import judge_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query
def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents at 4-word shingle similarity 0.8 or more."""
    return near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


@query
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated lines dropped; counts and the digest of what stays."""
    out = drop_repeated_lines(table(spark, sf_dir, "documents"), min_length=20, min_docs=3)
    return out.select(F.col("doc.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


#: Lines of documents with their keys, as a CTE body over (doc_id, text).
LINES_SQL = f"""
select doc_id, unnest(generate_series(1, len(ls))) as pos, unnest(ls) as line,
  unnest(list_transform(ls, lambda l: translate(trim(l, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), '{UPPER}', '{LOWER}'))) as key
from (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from {{src}})
"""
REPEATED_SQL = "select key, max(doc_id) as keeper from {lines} where length(key) >= 20 group by key having count(distinct doc_id) >= 3"

ORACLES["op8_line_dedup"] = f"""
with lines as ({LINES_SQL.format(src="documents")}), repeated as ({REPEATED_SQL.format(lines="lines")}),
marked as (select l.*, r.keeper is not null and l.doc_id <> r.keeper as gone from lines l left join repeated r using (key))
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from marked group by doc_id
"""

#: Direct statement of near-duplicate groups: distinct shingles, pairs that share one, closure of the links.
ORACLES["op6_minhash_near_dedup"] = f"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') as ws from documents),
sets as (select doc_id, list_distinct(case when len(ws) = 0 then []::varchar[] when len(ws) < 4 then [array_to_string(ws, ' ')]
  else list_transform(generate_series(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+3], ' ')) end) as s from w),
posted as (select doc_id, len(s) as n, unnest(s) as g from sets),
pairs as (select a.doc_id as a, b.doc_id as b from posted a join posted b on a.g = b.g and a.doc_id <> b.doc_id
  group by a.doc_id, b.doc_id having 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
reach(doc_id, c) as (select doc_id, doc_id from sets union select p.b, r.c from reach r join pairs p on p.a = r.doc_id where p.b > r.c)
select s.doc_id, len(s.s) as n_shingles, min(r.c) as component_id, min(r.c) = s.doc_id as kept
from sets s join reach r using (doc_id) group by s.doc_id, len(s.s)
"""


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written as Arrow stream files and read back."""
    index = write_token_files(table(spark, sf_dir, "documents"), new_path(spark, "tokens"), _vocabulary("byte_bpe_50k.json"))
    return stored(index)


@query
def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents by the transducer, and the bytes that they decode to."""
    import public_tokenizers

    ranks = _vocabulary("byte_bpe_50k.tiktoken")
    rows = encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, public_tokenizers.PATTERN)
    return digests(rows, ranks)

#: Fixed by the contract: (verdict, rule).
URL_RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Bounds of the labelled samples that models are fitted on.
QUALITY_SAMPLE, LANGUAGE_SAMPLE, TOXIC_SAMPLE = 12_000, 4_000, 12_000


@query
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on every page's URL."""
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def _scored(scores: DataFrame, held_out: Column) -> DataFrame:
    return scores.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from labels outside the held-out quarter."""
    docs, part = table(spark, sf_dir, "documents"), id_remainder(F.col("doc_id"), 4)
    told = labelled_texts(docs, table(spark, sf_dir, "labels"), "quality", part != 2, QUALITY_SAMPLE)
    return _scored(score_quality(docs, learn_quality(told)), part == 2)


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main language of every document, learned outside the held-out fifth."""
    docs, part = table(spark, sf_dir, "documents"), id_remainder(F.col("doc_id"), 5)
    told = docs.where((part != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    ids = bounded(told.select("doc_id"), LANGUAGE_SAMPLE, "doc_id")
    model = learn_languages(told.select("doc_id", "text", "lang").join(F.broadcast(ids), "doc_id"))
    return identify_languages(docs, model).select("doc_id", (part == 0).alias("held_out"), "lang_pred", "score")


def toxic_lexicon(docs: DataFrame, labels: DataFrame) -> Lexicon:
    """Learned from labels outside the held-out third."""
    return learn_lexicon(labelled_texts(docs, labels, "toxic", id_remainder(F.col("doc_id"), 3) != 1, TOXIC_SAMPLE))


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from labels outside the held-out third."""
    docs = table(spark, sf_dir, "documents")
    scores = score_toxicity(docs, toxic_lexicon(docs, table(spark, sf_dir, "labels")))
    return _scored(scores, id_remainder(F.col("doc_id"), 3) == 1)


@query
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, also with other numbers, names or units."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of embeddings of one label at cosine 0.93 or more."""
    return near_embeddings(table(spark, sf_dir, "embeddings"), cosine=0.93)


ORACLES["op9_embedding_near_dedup"] = """
with recursive v as (
  select vec_id, label, cast(embedding as double[]) as e from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(embedding) > 0),
good as (select *, sqrt(list_dot_product(e, e)) as norm from v
  where len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
pairs as (select a.vec_id as a, b.vec_id as b from good a join good b
  on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93),
reach(vec_id, c) as (select vec_id, vec_id from embeddings union select p.b, r.c from reach r join pairs p on p.a = r.vec_id where p.b > r.c),
links as (select a as vec_id, count(*) as n from pairs group by a)
select r.vec_id, coalesce(any_value(l.n), 0) as n_links, min(r.c) as component_id, min(r.c) = r.vec_id as kept
from reach r left join links l using (vec_id) group by r.vec_id
"""


@query
def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rounds of Lloyd's algorithm over all embeddings, in whole numbers."""
    return inertia_and_digests(cluster_vectors(table(spark, sf_dir, "embeddings"), k=16, rounds=3, dim=64, scale=64.0, seed=1))


def _lloyd_sql(k: int, rounds: int) -> str:
    step = """,
a{r} as (select vec_id, cluster, d from (select x.vec_id, k.cluster, sum((x.v - k.v) * (x.v - k.v)) as d
  from x join c{r} k using (j) group by x.vec_id, k.cluster) qualify row_number() over (partition by vec_id order by d, cluster) = 1)"""
    move = """,
s{r} as (select a.cluster, x.j, sum(x.v) as s, count(*) as n from a{r} a join x using (vec_id) group by a.cluster, x.j),
c{q} as (select c{r}.cluster, c{r}.j, coalesce((s - ((s % n) + n) % n) // n, c{r}.v) as v from c{r} left join s{r} using (cluster, j))"""
    rounds_sql = "".join(step.format(r=r) + move.format(r=r, q=r + 1) for r in range(rounds)) + step.format(r=rounds)
    return f"""
with good as (select vec_id, cast(embedding as double[]) as e from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda t: t is null or not isfinite(t))) = 0),
x as (select vec_id, unnest(generate_series(1, 64)) as j, unnest(list_transform(e, lambda t: cast(floor(64 * t) as bigint))) as v from good),
c0 as (select f.cluster, x.j, x.v from x join (select vec_id, row_number() over (order by sha256('1:' || vec_id)) - 1 as cluster
  from good qualify cluster < {k}) f using (vec_id)){rounds_sql},
per as (select cluster, sum(d) as i from a{rounds} group by cluster),
texts as (select cluster, sha256(string_agg(cast(v as bigint)::varchar, ',' order by j)) as h from c{rounds} group by cluster)
select vec_id, cast(a.cluster as int) as cluster, cast(d as bigint) as distance, cast(i as bigint) as cluster_inertia,
  cast((select sum(i) from per) as bigint) as inertia, h as centroid_sha256
from a{rounds} a join per using (cluster) join texts using (cluster)
"""


ORACLES["op11_centroid_clustering"] = _lloyd_sql(16, 3)


@query
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents, drawn towards the benchmark's words and word pairs."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=25, least_words=20, width=2, buckets=10_000, seed=7)


#: crc32 byte by byte over a table of 256 entries; every distinct feature once.
ORACLES["op12_importance_resampling"] = f"""
with recursive t(i, k, v) as (select i, 0, i from range(256) r(i) union all
  select i, k + 1, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end from t where k < 8),
crc as (select list(v order by i) as tab from t where k = 8),
w as (select side, id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws
  from (select 'd' as side, doc_id as id, text from documents union all select 'b', item_id, text from benchmark)),
runs as (select side, id, unnest(list_concat(ws, list_transform(generate_series(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1]))) as f from w),
held as (select side, id, f, count(*) as n from runs group by side, id, f),
bytes as (select f, hex(encode(f)) as h from (select distinct f from held)),
bucketed as (select f, xor(list_reduce(list_transform(generate_series(1, len(h), 2), lambda i: cast('0x' || substr(h, i, 2) as bigint)),
  lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1]), 4294967295), 4294967295) % 10000 as bucket from bytes, crc),
counts as (select bucket, coalesce(sum(n) filter (side = 'd'), 0) as s, coalesce(sum(n) filter (side = 'b'), 0) as t
  from held join bucketed using (f) group by bucket),
gains as (select bucket, cast(floor(1000 * ln(((t + 1)::double * ((select sum(s) from counts) + 10000)::double)
  / ((s + 1)::double * ((select sum(t) from counts) + 10000)::double))) as bigint) as gain from counts),
sums as (select id, sum(n) as n, sum(n * gain) as g from held join bucketed using (f) join gains using (bucket) where side = 'd' group by id),
scored as (select w.id, len(ws) as words, coalesce(s.n, 0)::bigint as n, coalesce((g - ((g % s.n) + s.n) % s.n) // s.n, 0)::bigint as weight
  from w left join sums s using (id) where side = 'd'),
noisy as (select *, weight + cast(floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || id), 1, 8))::bigint + 0.5::double) / 4294967296::double))) as bigint) as score from scored),
drawn as (select id, row_number() over (order by score desc, id) as rank from noisy where words >= 20
  qualify rank <= 25 * count(*) over () // 100)
select id as doc_id, n as n_features, weight, score, rank from noisy left join drawn using (id)
"""


@query
def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations as budgeted windows, read back from them."""
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return conversation_digests(materialize(format_conversations(rows, _vocabulary("byte_bpe_50k.json")), "windows"))
