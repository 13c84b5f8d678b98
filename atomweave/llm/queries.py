"""The query of each operator, over its whole table, and SQL for those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, html_text, licenses, media, minhash, neighbours, ngram, packing, pii, toxicity
from .common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.store_and_read(table(spark, sf_dir, "documents"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digests(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = toxicity.train(docs, table(spark, sf_dir, "labels"), where=toxicity.fold("doc_id", 3) != 1)
    held_out = F.coalesce(toxicity.fold("doc_id", 3) == 1, F.lit(False))
    return toxicity.score(docs, net).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(table(spark, sf_dir, "documents"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return neighbours.search(rows, rows.where("vec_id % 50 = 0"), k=5)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=80)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op10_ngram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram.score_held_out(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_media_columns, op2_licenses, op3_toxicity, op4_pii, op5_html_text, op6_neighbours, op7_bpe, op8_minhash, op9_packing, op10_ngram)}

ORACLE_SQL: dict[str, str] = {
    "op6_neighbours": """
with v as (select vec_id, cast(embedding as double[]) as e from embeddings
  where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
s as (select q.vec_id as query_id, c.vec_id as vec_id, list_inner_product(q.e, c.e) / (sqrt(list_inner_product(q.e, q.e)) * sqrt(list_inner_product(c.e, c.e))) as score
  from v q join v c on q.vec_id % 50 = 0 and len(q.e) = len(c.e) and q.vec_id <> c.vec_id),
r as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s)
select query_id, rank, vec_id, score from r where rank <= 5
""",
    "op8_minhash": """
with recursive words as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') as w from documents),
sets as (select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 4 then [w] else list_transform(range(1, len(w) - 2), lambda i: w[i : i + 3]) end) as s from words),
shingles as (select doc_id, len(s) as n, unnest(s) as x from sets),
common as (select a.doc_id as a, b.doc_id as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as c from shingles a join shingles b on a.x = b.x and a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) group by all),
links as (select a, b from common where 100 * c >= 80 * (na + nb - c)),
both_ways as (select a, b from links union all select b, a from links),
reach as (select doc_id as a, doc_id as b from sets union select r.a, l.b from reach r join both_ways l on l.a = r.b),
least_of as (select a as doc_id, min(b) as component_id from reach group by a)
select s.doc_id, cast(len(s) as bigint) as n_shingles, component_id, s.doc_id = component_id as kept from sets s join least_of l on l.doc_id = s.doc_id
""",
}
