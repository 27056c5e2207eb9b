"""The training-data pipeline: documents in, token ids in training order out.

Each stage is a function ``(spark, docs, sf_dir) -> DataFrame``; its result is
written as Parquet to the shared folder and read back as the next one's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docfields.llm.common import running_sum, saved
from docfields.llm.minhash import near_duplicates
from docfields.llm.mixing import mix
from docfields.llm.quality import keep_good
from docfields.llm.substring import dedup_substrings
from docfields.llm.unigram import encode_documents
from docfields.sources.tables import read_table

PIECES = "piece_bpe_32k.model"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return keep_good(docs, public_tokenizers.path(PIECES))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, 0.8).

    Rows that repeat an id and its text are one document, of which one row
    stays. Different texts of an id are documents of their own: where there are
    such, documents are compared under their number in the order of id and key.
    """
    # the stage's own names stand beside a row, so columns of any name and kind pass
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    known = whole.where("row.doc_id is not null").select(
        F.col("row.doc_id").alias("id"), F.xxhash64("row.text").alias("key"), "row")
    again = saved(known.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"), "near-again")
    if again.head(1):
        firsts = known.join(again, "id", "left_semi").groupBy("id", "key").agg(F.min_by("row", F.to_json("row")).alias("row"))
        known = known.join(again, "id", "left_anti").unionByName(firsts)
        texts = known.select("id", "key", F.lit(1).alias("one"))
        numbers = running_sum(texts, [F.col("id"), F.col("key")], "one", "number", "near-numbers").drop("one")
        known = known.join(numbers, ["id", "key"])
    else:
        known = known.withColumn("number", F.col("id"))
    kept = near_duplicates(known.select(F.col("number").alias("doc_id"), "row.text"), k=5, percent=80).where("kept")
    known = known.join(kept.select(F.col("doc_id").alias("number")).distinct(), "number", "left_semi")
    columns = [F.col("row").getField(c).alias(c) for c in docs.columns]
    return known.select(*columns).unionByName(whole.where("row.doc_id is null").select(*columns))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one holds."""
    return dedup_substrings(docs, details=False).withColumn("n_chars", F.length("text").cast("long"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, sources at their target weights."""
    return mix(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, in the order of training."""
    return encode_documents(docs, public_tokenizers.path(PIECES))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("mixing", mixing),
          ("sentencepiece", sentencepiece)]

#: Several stages cannot be said in SQL; tests hold each against a brute-force form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
