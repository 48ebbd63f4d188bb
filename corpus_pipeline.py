"""The corpus pipeline: quality, near duplicates, personal data, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; stages are
written as Parquet between each other. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from profilelake.llm import minhash, mixing, packing, pii, quality
from profilelake.llm.common import crc_of_id
from profilelake.session import materialized

ORACLE_SQL = None       # scores, sampling and tokenisation are beyond SQL; tests hold the stages against plain versions


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality vote does not reject (score of at least 0.3)."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(crc_of_id("doc_id") % 5 != 0)
    scored = quality.score(docs, quality.fit(docs, labels), column="quality_score__")
    return scored.where("quality_score__ >= 0.3").drop("quality_score__")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id.

    Of repeated rows with one id and text one stays; rows with a null id all stay.
    """
    groups = minhash.near_duplicates(docs).where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("kept_id__")).distinct()
    with_id = docs.where("doc_id IS NOT NULL").join(groups, F.col("doc_id") == F.col("kept_id__"), "left_semi").dropDuplicates(["doc_id", "text"])
    return with_id.unionByName(docs.where("doc_id IS NULL"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with their personal data replaced by its kind; ``n_chars`` follows the text."""
    found = pii.find(docs, pii.fit(docs), base_col="base__", all_col="spans__")
    text = pii.redacted(F.col("text"), F.col("spans__"))
    return found.withColumn("text", text).withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus in training order: documents repeated, cut or left out by their source's share and schedule."""
    mixed = mixing.mix(docs, schedules=mixing.CURRICULUM)
    return mixed.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 2048 ids, with their ids."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality classifier", keep_good), ("near duplicates", keep_one_of_each), ("personal data", redact),
          ("mixture", mix), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialized(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
