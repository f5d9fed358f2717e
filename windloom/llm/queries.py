"""One query for each operator, applied to its whole table; SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windloom.llm import chat, decontaminate, langid, neighbours, pieces, pii, secrets, simhash, toxicity, warc
from windloom.llm.common import held_out, table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, lexicon).withColumn("held_out", held_out(F.col("doc_id"))).select("doc_id", "held_out", "score", "predicted")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return neighbours.search(rows, rows.where("vec_id % 100 = 0"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repair(table(spark, sf_dir, "conversations"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encodings(table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.extract(table(spark, sf_dir, "documents"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = langid.identify(docs, langid.prototypes(docs))
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES = {f.__name__: f for f in (op1_warc, op2_toxicity, op3_secrets, op4_neighbours, op5_simhash, op6_decontaminate, op7_chat, op8_sentencepiece, op9_pii, op10_langid)}

ORACLE_SQL = {
    "op1_warc": """
with p as (select page_id, coalesce(html, '') as html, octet_length(encode(coalesce(html, ''))) as n, sha1(coalesce(html, '')) as digest from pages),
     g as (select digest, max(page_id) as first_id from p where n >= 1000 group by digest)
select p.page_id, cast(p.n as bigint) as payload_bytes, p.digest as payload_digest,
       case when g.first_id is not null and p.page_id is distinct from g.first_id then 'revisit' else 'response' end as record_type,
       case when g.first_id is not null and p.page_id is distinct from g.first_id then g.first_id end as refers_to
from p left join g on p.digest = g.digest and p.n >= 1000
""",
    "op6_decontaminate": r"""
with words as (
  select 'd' as kind, doc_id as id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
  union all
  select 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') from benchmark),
 items as (select id, w, least(10, len(w)) as m from words where kind = 'b' and len(w) > 0),
 windows as (select distinct id as item_id, m, array_to_string(w[i : i + m - 1], ' ') as win from (select id, w, m, unnest(range(1, len(w) - m + 2)) as i from items)),
 sizes as (select distinct m from windows),
 places as (select id, m, i, array_to_string(w[i : i + m - 1], ' ') as win from (select id, w, m, unnest(range(1, len(w) - m + 2)) as i from words, sizes where kind = 'd' and len(w) >= m)),
 hits as (select p.id, p.m, p.i, b.item_id from places p join windows b on p.m = b.m and p.win = b.win),
 hit_words as (select id, count(distinct k) as n_hit from (select id, unnest(range(i, i + m)) as k from hits) group by id),
 hit_items as (select id, count(*) as n_items, string_agg(s, ',' order by s) as ids from (select distinct id, cast(item_id as varchar) as s from hits where item_id is not null) group by id)
select w.id as doc_id, cast(len(w.w) as bigint) as n_words, coalesce(h.n_hit, 0) as n_hit, coalesce(i.n_items, 0) as n_items, sha256(coalesce(i.ids, '')) as items_sha256, coalesce(h.n_hit, 0) > 0 as contaminated
from words w left join hit_words h on w.id = h.id left join hit_items i on w.id = i.id where w.kind = 'd'
""",
}
