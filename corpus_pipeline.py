"""From documents to packed training sequences: five stages, each written as Parquet and read again by the next.

Every stage but the last returns the columns of documents. What a stage decides takes effect: language ID drops texts
without any letter, the dedup stages keep one document of each group, the PII stage masks what it finds.
A table without rows gives none at every stage, and null ids and texts are defined by the operators.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import exact_dedup, langid, minhash, packing, pii
from paperloom.runtime import written

#: A list of ids is broadcast up to so many rows (8 bytes each), and joined by exchange beyond; the rows are the same.
BROADCAST_ROWS = 1_000_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sets lang to the predicted language; documents without a letter go.

    Texts in no learned language, markup and gibberish with a letter stay, under a forced guess. Where no row with a
    language could be learned from, lang stays as it is.
    """
    kept = langid.identify(docs).where((F.col("lang_pred") != langid.UNKNOWN) | (F.col("score") == 0))
    lang = F.when(F.col("lang_pred") != langid.UNKNOWN, F.col("lang_pred")).otherwise(F.col("lang"))
    return kept.select(*[lang.alias(c) if c == "lang" else F.col(c) for c in docs.columns])


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts (but for the case of A-Z) the one with the smallest id stays."""
    return _only(docs, exact_dedup.exact_duplicates(docs, keep="smallest"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents joined by links of five-word shingles at a similarity of 0.8 or more, the smallest id stays."""
    return _only(docs, minhash.near_duplicates(docs, width=5, percent=80))


def _only(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Documents whose id found doesn't drop; rows that repeat an id and its text become one, rows without an id all stay.

    Texts stay where they are: lists of ids are joined to them, and only rows whose id occurs more than once are exchanged.
    """
    dropped = written(found.where(~F.col("kept")).select(F.col("id").alias("doc_id")).distinct(), "dropped")
    again = written(docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "again")
    named = docs.join(_listed(dropped), "doc_id", "left_anti")
    once = named.join(_listed(again), "doc_id", "left_anti").select(*docs.columns)
    twins = named.join(_listed(again), "doc_id", "left_semi").select(F.struct(*docs.columns).alias("row"), "doc_id", F.sha2("text", 256).alias("digest"))
    return once.unionByName(twins.dropDuplicates(["doc_id", "digest"]).select("row.*"))


def _listed(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids.hint("merge")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data in text and sets n_chars to the new length; no document goes."""
    return pii.mask(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens."""
    found = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, end_id=1)
    return found.withColumnRenamed("id", "doc_id")


STAGES = [("language_id", language), ("exact_dedup", exact), ("near_dedup", near), ("pii", personal_data), ("packing", pack)]
#: Neither the trained stages nor the tokenizer can be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
