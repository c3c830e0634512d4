"""A corpus pipeline of five stages; each takes the documents that the one before has kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenmark.llm.common import shared_folder
from evenmark.llm.decontaminate import leaks
from evenmark.llm.language import identify, learn_profiles
from evenmark.llm.minhash import near_duplicates
from evenmark.llm.pieces import default_vocabulary, encode
from evenmark.llm.suffixes import repeated_spans

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found. Those of null or empty text, or without a letter, go; repeated rows stay."""
    rest = F.struct(*[c for c in COLUMNS if c != "text"])
    found = identify(docs.select(rest.alias("row"), "text"), learn_profiles(docs), "row", "text", carry_text=True)
    return found.where("lang_pred <> 'und'").select("row.*", "text").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id, with all its rows. Null and empty texts and null ids are in no group and stay; an empty table stays empty."""
    kept = near_duplicates(docs).where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.select(*COLUMNS).join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi")


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 50 bytes that earlier documents hold; what is not whole characters any more goes too. All rows stay: a null text becomes an empty one, rows of one id do not cut each other."""
    text = F.make_valid_utf8(F.col("kept").cast("string"))
    left = repeated_spans(docs, carry=("lang", "source")).withColumn("text", F.when(F.col("n_spans") > 0, F.regexp_replace(text, "\ufffd", "")).otherwise(text))
    return left.select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts hold none and stay; rows of one id, null ids too, count as one document."""
    found = leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(F.col("doc_id").alias("leaked")).distinct()
    return docs.select(*COLUMNS).join(found, F.col("doc_id").eqNullSafe(F.col("leaked")), "left_anti")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids and two sampled segmentations. Empty texts have no ids; repeated rows repeat theirs."""
    done = encode(docs, default_vocabulary())
    return done.select("doc_id", "ids", F.size("ids").alias("n_tokens"), "samples")


STAGES = [("language", language), ("near_dedup", near_dedup), ("repeats", repeats), ("decontaminate", decontaminate), ("tokenize", tokenize)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again in the folder that executors share, under a new name for each run."""
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
