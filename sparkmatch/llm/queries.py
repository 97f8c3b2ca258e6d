"""The queries of the training-data operators: each applies its operator to its whole table and returns the digest columns.

``ORACLE_SQL`` has the queries that SQL can express; ``tests/llm`` hold the others against the library concerned, a
brute-force version or held-out accuracy.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C
from . import bpe, decontam, html_text, langid, near_dup, quality, token_counts, topk, toxicity, training_order

BYTE_BPE = "byte_bpe_50k.tiktoken"
PIECE_BPE = "piece_bpe_32k.model"


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents", "doc_id", "text")
    return bpe.digest(docs, public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN, keep_text=False)


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = C.table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return topk.search(vectors, vectors.where(F.col("vec_id") % 100 == 0), k=10)


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(C.table(spark, sf_dir, "documents", "doc_id", "text"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = C.table(spark, sf_dir, "pages", "page_id", "url", "html")
    return html_text.extract(pages, html_text.trained(), keep_html=False)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = langid.train(docs, parts=3, part=1)
    asked = docs.select("doc_id", C.held_out("doc_id", 3, 1).alias("held_out"), "text")
    return langid.identify(asked, model, keep_text=False)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents", "doc_id", "text")
    return decontam.leaks(docs, C.table(spark, sf_dir, "benchmark", "item_id", "text"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents", "doc_id", "text")
    machine = toxicity.train(docs, C.table(spark, sf_dir, "labels", "doc_id", "toxic"), parts=5, part=0)
    asked = docs.select("doc_id", C.held_out("doc_id", 5, 0).alias("held_out"), "text")
    return toxicity.score(asked, machine, threshold=0.5, keep_text=False)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents", "doc_id", "text")
    return token_counts.count_tokens(docs, public_tokenizers.path(PIECE_BPE), limit=4096, keep_text=False)


def op9_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents", "doc_id", "text")
    base = f"{C.scratch_dir(spark)}/training-order-{uuid.uuid4().hex}"
    return training_order.write(docs, public_tokenizers.path(PIECE_BPE), base)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents", "doc_id", "text")
    model = quality.train(docs, C.table(spark, sf_dir, "labels", "doc_id", "quality"), parts=4, part=2)
    asked = docs.select("doc_id", C.held_out("doc_id", 4, 2).alias("held_out"), "text")
    return quality.score(asked, model, threshold=0.7, keep_text=False)


QUERIES = {f.__name__: f for f in (op1_byte_bpe, op2_top_k, op3_near_duplicates, op4_html_text, op5_language, op6_decontamination, op7_toxicity, op8_token_counts, op9_training_order, op10_quality)}

_SHINGLES = """
  select {key}, array_to_string(w[i:least(i + 4, len(w))], ' ') as s
  from (select {key}, w, unnest(range(1, greatest(len(w) - 3, 2))) as i
        from (select {key}, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') as w from {table}) where len(w) > 0)
"""

ORACLE_SQL: dict[str, str] = {
    "op2_top_k": """
with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * cast(x as double))) as v from embeddings
           where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
     met as (select q.vec_id as query_id, v.vec_id, cast(list_inner_product(q.v, v.v) as bigint) as score
             from v q join v on q.vec_id <> v.vec_id where q.vec_id % 100 = 0)
select query_id, cast(n as integer) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as n from met) where n <= 10
""",
    "op3_near_duplicates": f"""
with recursive occ as (select doc_id, s, count(*) as n from ({_SHINGLES.format(key="doc_id", table="documents")}) group by 1, 2),
     df as (select s, greatest(1, round(8 * ln(1 + (select count(*) from documents) / count(*)))) as w, count(*) as n_docs from occ group by 1),
     total as (select doc_id, sum(n * w) as t from occ join df using (s) group by 1),
     often as (select doc_id, s, n, w from occ join df using (s) where n_docs > 1),
     met as (select a.doc_id as a, b.doc_id as b, sum(least(a.n, b.n) * a.w) as c from often a join often b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
     link as (select a, b from met join total x on x.doc_id = a join total y on y.doc_id = b where 5 * c >= 4 * (x.t + y.t - c)),
     edge as (select a, b from link union all select b, a from link),
     reach(doc_id, class_id) as (select doc_id, doc_id from documents union select b, class_id from reach join edge on a = reach.doc_id and class_id < b)
select doc_id, min(class_id) as class_id from reach group by 1
""",
    "op6_decontamination": f"""
with item as (select distinct * from ({_SHINGLES.format(key="item_id", table="benchmark")})),
     held as (select distinct * from ({_SHINGLES.format(key="doc_id", table="documents")})),
     sizes as (select item_id, count(*) as n_shingles from item group by 1),
     found as (select doc_id, item_id, count(*) as n_found from held join item using (s) group by 1, 2)
select doc_id, item_id, n_found, n_shingles, n_found / n_shingles as containment
from found join sizes using (item_id) where n_found >= 0.8 * n_shingles
""",
}
