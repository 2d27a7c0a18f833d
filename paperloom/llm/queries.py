"""Queries over the test tables, one per operator, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table
from . import bpe, langid, multi_index, packing, pii, secret_scan, toxicity
from .exact_dedup import exact_duplicates
from .learning import held_out
from .minhash import near_duplicates
from .sharding import shuffle_into_shards

SHARDS = 16


def op1_crf_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def op2_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return multi_index.nearest(rows, rows.where(F.col("vec_id") % 100 == 0), k=10)


def op3_guess_cost_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op4_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def op5_hierarchical_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.where(~held_out("doc_id") & F.col("doc_id").isNotNull()), "doc_id", "text", "lang")
    return langid.identify(docs.select("doc_id", "text"), model=model).select("doc_id", "held_out", "lang_pred", "score")


def op6_weak_supervision_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(~held_out("doc_id")))
    return toxicity.score(docs, model).select(F.col("id").alias("doc_id"), "held_out", "score", "predicted")


def op7_hypergeometric_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    body = F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary"))
    rows = docs.select("doc_id", (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    out = shuffle_into_shards(rows, ["doc_id", "text_crc32", "size"], SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, end_id=1)
    return found.withColumnRenamed("id", "doc_id")


def op9_recursive_sql_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return found.withColumnRenamed("id", "doc_id")


def op10_lsm_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_duplicates(table(spark, sf_dir, "documents"), keep="largest")
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


QUERIES = {
    "op1_crf_personal_data": op1_crf_personal_data,
    "op2_inverted_multi_index": op2_inverted_multi_index,
    "op3_guess_cost_secrets": op3_guess_cost_secrets,
    "op4_minmax_near_dedup": op4_minmax_near_dedup,
    "op5_hierarchical_language_id": op5_hierarchical_language_id,
    "op6_weak_supervision_toxicity": op6_weak_supervision_toxicity,
    "op7_hypergeometric_sharding": op7_hypergeometric_sharding,
    "op8_harmonic_packing": op8_harmonic_packing,
    "op9_recursive_sql_bpe": op9_recursive_sql_bpe,
    "op10_lsm_exact_dedup": op10_lsm_exact_dedup,
}

ASCII_LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE = {
    "op4_minmax_near_dedup": f"""
        with recursive w as (
                select doc_id, list_filter(regexp_split_to_array({ASCII_LOWER_SQL}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
             s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
                    else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end) as s from w),
             n as (select doc_id, count(*) as n from s group by doc_id),
             p as (select a.doc_id as x, b.doc_id as y, count(*) as both_ from s a join s b using (s) where a.doc_id <> b.doc_id group by all),
             e as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * both_ >= 80 * (a.n + b.n - both_)),
             r as (select doc_id as x, doc_id as y from documents union select r.x, e.y from r join e on r.y = e.x)
        select d.doc_id, coalesce(any_value(n.n), 0)::bigint as n_shingles, min(r.y) as component_id, d.doc_id = min(r.y) as kept
        from documents d join r on r.x = d.doc_id left join n on n.doc_id = d.doc_id group by d.doc_id""",
    "op10_lsm_exact_dedup": f"""
        with d as (select doc_id, sha256({ASCII_LOWER_SQL}) as text_sha256 from documents),
             g as (select text_sha256, max(doc_id) as keep_id, count(*) as group_size from d group by text_sha256)
        select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from d join g using (text_sha256)""",
}
