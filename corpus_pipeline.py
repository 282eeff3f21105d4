"""A corpus pipeline: language ID, exact dedup, near dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents, whatever further columns there are and however named.

Cases: null and empty texts, and those without a letter, go at the first stage; the stages after it take them as empty
texts, too. Ids may be null or repeat: rows are told apart by their texts, of equal ones the largest id stays, of near
ones the smallest, and of repeated rows one. Very long texts are kept whole. An empty table stays empty."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import exact_dedup, lang_id, near_dedup, packing
from tidewell.llm.common import shared_dir


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; those without any letter go. Where no labelled text gives a language, all with a
    letter stay."""
    model = lang_id.train(docs)
    if not model.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return lang_id.keep_identified(docs, model)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of all texts whose five-word shingles have a Jaccard similarity of 0.8 or more."""
    return near_dedup.keep_one(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, with_ids=False)


STAGES = [("language_id", keep_known_language), ("exact_dedup", drop_exact_copies), ("near_dedup", drop_near_copies), ("packing", pack_sequences)]

#: SQL can't express the language model or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
