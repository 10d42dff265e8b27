"""The corpus pipeline: toxicity, SimHash near-dedup, benchmark decontamination, secret scans, SentencePiece encoding and decoding.

Each stage takes (spark, docs, sf_dir) and returns a frame; `run` writes it as Parquet into the shared folder and reads it again for the next.
All but the last return the columns of `documents`.

In each stage a null text counts as empty, repeated rows and rows that share an id are judged each by its own text, null ids are ids like any other, an empty table
gives an empty table, and columns besides those named are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boutline.llm import decontaminate, queries, secrets, sentencepieces, simhash, toxicity
from boutline.llm.scratch import Scratch, clearing

#: The stages score against labels and a benchmark model that SQL can't hold.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar, learned from the labelled rows outside the held-out fold, scores under 0.5.  Null and empty texts score the base
    rate and stay; rows of one id are scored one by one."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group that SimHash links at 2 bits or fewer join.  Null, empty and blank texts are one group; of repeated rows one stays,
    and rows that share an id but not a text are told apart by their texts."""
    return simhash.without_near_duplicates(spark, docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of 0.8 similarity or more to a benchmark item.  Null and empty texts hold none; rows that share an id stay or go by their own text."""
    return decontaminate.without_leaks(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; credentials that aren't widely copied examples are replaced in their texts.  Null texts stay null."""
    return secrets.redact_documents(spark, docs, owner="source", repo=F.concat_ws("/", "source", "lang"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, round_trip: whether decoding gives the text back.  Null and empty texts have no ids and come back."""
    model = sentencepieces.load(spark, queries.SENTENCEPIECE_MODEL)
    both = sentencepieces.encode(docs.select("doc_id", "lang", "source", "text"), model, out="ids", round_trip="round_trip")
    return both.select("doc_id", "lang", "source", F.size("ids").alias("n_tokens"), "ids", "round_trip")


STAGES = [("toxicity", drop_toxic), ("simhash", drop_near_duplicates), ("decontaminate", drop_leaks), ("secrets", redact_secrets), ("sentencepiece", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before = docs
        with clearing():  # a stage's own tables go once its rows are written
            docs = scratch.table(stage(spark, before, sf_dir), name)
        scratch.drop(before)
    return docs
