"""The corpus pipeline: documents to packed training sequences in five stages, each one operator on all that is left.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame, which run() writes as Parquet to the shared folder and
reads again, so a lost executor costs one stage at most. All stages but the last give the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hinode.llm.common import bounded_batches, crc_mod, materialize, read_table
from hinode.llm.decontaminate import decontaminate
from hinode.llm.langid import UNDETERMINED, predict_languages, train_language_model
from hinode.llm.near_dedup import drop_near_duplicates
from hinode.llm.packing import best_fit_pack
from hinode.llm.queries import tokenizer_file
from hinode.llm.secrets import redact_secrets


#: Texts whose word shingles are alike by this share in a hundred are near-duplicates in the pipeline.
NEAR = 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; a missing lang is filled in."""
    bounded_batches(spark)
    model = train_language_model(docs.where(crc_mod("doc_id") != 0))
    told = predict_languages(docs, model).where(F.col("lang_pred") != UNDETERMINED)
    return told.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicate texts, whatever their doc_id; all rows without words stay."""
    bounded_batches(spark)
    return drop_near_duplicates(docs, share=NEAR)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    bounded_batches(spark)
    return decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in them replaced by a mark."""
    bounded_batches(spark)
    return redact_secrets(docs).withColumn("n_chars", F.coalesce(F.char_length("text"), F.col("n_chars")).cast("long")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences."""
    bounded_batches(spark)
    return best_fit_pack(docs, tokenizer_file())


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination), ("secret_scan", secret_scan), ("packing", packing)]

#: Trained models and a tokenizer can't be said in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
