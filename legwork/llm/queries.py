"""The queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import clustering, decontaminate, extract, fingerprint, langid, merkle, neardup, neighbours, packing, pii, repeats, sharding, toxicity
from .common import table
from .oracles import clustering_sql, merkle_sql


def tokenizer_path() -> str:
    """The public vocabulary file of the packing query."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), capacity=2048, end_id=0)


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"), words=5, similarity=0.8)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeats(table(spark, sf_dir, "documents"), window=35).drop("kept", "spans")


#: Key of the pseudonyms in the query and the pipeline; a deployment passes its own.
PII_KEY = "demonstration key"


def op7_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"), PII_KEY)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10).drop("items")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=8, vnodes=64)


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op11_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.report(table(spark, sf_dir, "embeddings"), k=8, rounds=10, dims=64, scale=1024.0, seed=3)


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.report(table(spark, sf_dir, "documents"))


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.neighbours(table(spark, sf_dir, "embeddings"), k=20, every=20)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_extract, op2_packing, op3_near_duplicates, op4_toxicity, op5_language, op6_repeats, op7_pseudonyms, op8_decontaminate, op9_sharding, op10_fingerprint, op11_clustering, op12_merkle, op13_neighbours, pipeline)}

ORACLE: dict[str, str] = {
    "op6_repeats": r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (select doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) as h from d, unnest(generate_series(1, len(w) - 34)) u(i) where len(w) >= 35),
rep as (select h from win group by h having count(*) > 1),
gone as (select distinct doc_id, j from win semi join rep using (h), unnest(generate_series(i, i + 34)) v(j)),
words as (select doc_id, j, w[j] as word from d, unnest(generate_series(1, len(w))) v(j)),
kept as (select doc_id, string_agg(word, ' ' order by j) as t, count(*) as k from words anti join gone using (doc_id, j) group by doc_id)
select d.doc_id, len(w)::bigint as n_words, (len(w) - coalesce(k, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256 from d left join kept using (doc_id)
""",
    "op8_decontaminate": r"""
with it as (select item_id::varchar as id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
g as (select distinct id, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') as gram, least(10, len(w)) as n from it, unnest(generate_series(1, greatest(1, len(w) - 9))) u(i) where len(w) > 0),
d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
p as (select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') as gram from d, (select distinct n from g) s, unnest(generate_series(1, len(w) - n + 1)) u(i) where len(w) >= n),
h as (select distinct doc_id, i, n, id from p join g using (gram, n)),
hit as (select doc_id, count(distinct j) as k from h, unnest(generate_series(i, i + n - 1)) v(j) group by doc_id),
its as (select doc_id, count(distinct id) as m, sha256(string_agg(distinct id, ',' order by id)) as s from h group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(k, 0) as n_hit, coalesce(m, 0) as n_items, coalesce(s, sha256('')) as items_sha256, coalesce(k, 0) > 0 as contaminated from d left join hit using (doc_id) left join its using (doc_id)
""",
    "op11_clustering": clustering_sql(),
    "op12_merkle": merkle_sql(),
}
