"""Registered queries of this package, over whole tables, and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shopcast.llm import centroids, chat, dedup, divergence, licenses, mixing, packing, pieces, quality, simhash, tokens, topk, toxicity
from shopcast.llm.common import read
from shopcast.session import prepare


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return read(spark, sf_dir, "documents")


def _held_out(parts: int, rest: int) -> Column:
    """Whether crc32 of the id as text leaves ``rest``; false without an id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == rest, F.lit(False))


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    out = chat.format_chats(read(spark, sf_dir, "conversations"))
    return out.select("conv_id", "n_copies", F.size("turns").cast("long").alias("n_turns"), "text")


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf_dir))


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return topk.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = quality.labelled(read(spark, sf_dir, "labels").where(~_held_out(3, 1)), "quality")
    out = quality.scores(_documents(spark, sf_dir), labels)
    return out.select("doc_id", _held_out(3, 1).alias("held_out"), "score", "predicted")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.groups(_documents(spark, sf_dir))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = toxicity.labelled(read(spark, sf_dir, "labels").where(~_held_out(5, 0)), "toxic")
    out = toxicity.scores(_documents(spark, sf_dir), labels)
    return out.select("doc_id", _held_out(5, 0).alias("held_out"), "score", "predicted", "evidence")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(_documents(spark, sf_dir))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_documents(spark, sf_dir))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return centroids.cluster(read(spark, sf_dir, "embeddings"))


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(_documents(spark, sf_dir)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "same")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_chat_formatting, op2_source_mixing, op3_simhash_dedup, op4_exact_topk, op5_quality_classifier,
    op6_exact_dedup, op7_packing, op8_toxicity, op9_token_counts, op10_license_scan,
    op11_centroid_clustering, op12_sentencepiece, op13_source_divergence)}

ORACLES: dict[str, str] = {}

ORACLES["op1_chat_formatting"] = r"""
with t as (select distinct conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations),
n as (select *, row_number() over (partition by conv_id order by turn nulls last, role, sha256(length(role) || ':' || role || text)) as i from t),
p as (select conv_id, i, list(struct_pack(r := role, t := text)) over (partition by conv_id order by i) as prefix,
             count(*) over (partition by conv_id) as n from n),
c as (select prefix as turns, any_value(n) as n, min(conv_id) as conv_id, count(*) as n_copies from p where i = n group by prefix)
select c.conv_id, c.n_copies, c.n as n_turns,
       list_aggregate(list_transform(c.turns, lambda x: '<|im_start|>' || x.r || chr(10) || x.t || '<|im_end|>' || chr(10)), 'string_agg', '') as text
from c where not exists (select 1 from p where p.prefix = c.turns and p.i < p.n)
"""

ORACLES["op4_exact_topk"] = r"""
with v as (
  select vec_id, row_number() over () as uid, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
x as (select vec_id, uid, unnest(e) as c, generate_subscripts(e, 1) as i from v),
s as (
  select q.vec_id as query_id, q.uid as quid, k.vec_id, k.uid, sum(q.c * k.c) as score
  from x q join x k on q.i = k.i and q.uid <> k.uid
  where q.vec_id % 50 = 0 group by all),
r as (select *, row_number() over (partition by quid order by score desc, vec_id, uid) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, cast(score as bigint) as score from r where rank <= 5
"""

ORACLES["op6_exact_dedup"] = r"""
with d as (
  select doc_id, length(coalesce(text, '')) as n, sha256(translate(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) as h
  from documents),
g as (select *, first_value(doc_id) over (partition by h order by n desc, doc_id nulls last) as keep_id, max(n) over (partition by h) as most, count(*) over (partition by h) as group_size from d)
select doc_id, keep_id, group_size, doc_id is not distinct from keep_id and n = most as kept, h as text_sha256 from g
"""


def _lloyd_sql(rounds: int = centroids.ROUNDS, k: int = centroids.K) -> str:
    """Lloyd's rounds one after the other: e<n> the centroids' components, n<n> the assignment by them."""
    floor = "(s - ((s % n) + n) % n) // n"
    steps = [f"""
kept as (
  select vec_id, row_number() over () as uid, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v
  from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
x as materialized (select uid, unnest(v) as c, generate_subscripts(v, 1) as i from kept),
first as (select uid, row_number() over (order by sha256('{centroids.SEED}:' || vec_id) nulls last, v) - 1 as z from kept qualify z < {k}),
e0 as materialized (select z, i, c from first join x using (uid))"""]
    for r in range(rounds + 1):
        steps.append(f"""
n{r} as materialized (
  select uid, z, d from (select uid, z, sum((x.c - e{r}.c) * (x.c - e{r}.c)) as d from x join e{r} using (i) group by uid, z)
  qualify row_number() over (partition by uid order by d, z) = 1)""")
        if r < rounds:
            steps.append(f"""
m{r} as materialized (select z, i, sum(c) as s, count(*) as n from n{r} join x using (uid) group by z, i),
e{r + 1} as materialized (select e{r}.z, e{r}.i, cast(coalesce({floor}, e{r}.c) as bigint) as c from e{r} left join m{r} using (z, i))""")
    return f"""
with {','.join(steps)},
h as (select z, sha256(string_agg(cast(c as varchar), ',' order by i)) as centroid_sha256 from e{rounds} group by z)
select k.vec_id, cast(n.z as integer) as cluster, cast(n.d as bigint) as distance, cast(sum(n.d) over (partition by n.z) as bigint) as cluster_inertia,
       cast(sum(n.d) over () as bigint) as inertia, h.centroid_sha256
from n{rounds} n join kept k using (uid) join h using (z)
"""


ORACLES["op11_centroid_clustering"] = _lloyd_sql()

ORACLES["op13_source_divergence"] = r"""
with d as (
  select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as words
  from documents),
w as (select id, lang, source, unnest(words) as term from d),
kept as (select lang, term, count(*) as n from w group by lang, term having count(distinct id) >= 30),
langs as (select lang, count(*) as v, sum(n) as n from kept group by lang),
cells as (select w.lang, w.source, w.term, count(*) as n from w join kept using (lang, term) group by all),
sizes as (select lang, source, sum(n) as n from cells group by all),
g as (
  select distinct d.lang, d.source, coalesce(s.n, 0) as n, coalesce(l.v, 0) as v
  from d left join sizes s on s.lang = d.lang and s.source = d.source left join langs l on l.lang = d.lang),
p as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 5)) // (g.n + 5 * g.v) as p
  from g join kept k using (lang) left join cells c using (lang, source, term)),
q as (select lang, term, 1 + (1000000000::hugeint * (k.n + 5)) // (l.n + 5 * l.v) as q from kept k join langs l using (lang)),
pairs as (
  select a.lang, a.source, 'pair' as part, b.source as item,
         (select coalesce(sum(abs(x.p - y.p)), 0) from p x join p y using (lang, term) where x.lang = a.lang and x.source = a.source and y.source = b.source) as value
  from g a join g b on a.lang = b.lang and a.source <> b.source),
leads as (select lang, source, 'term' as part, term as item, p - q as value from p join q using (lang, term) where n > 0 and p > q),
r as (
  select *, row_number() over (partition by lang, source, part order by value desc, item) as rank
  from (select * from pairs union all select * from leads))
select lang, source, part, item, cast(value as bigint) as value, cast(rank as integer) as rank from r where part = 'pair' or rank <= 50
"""
