"""From raw documents to packed training sequences.

Stages: toxicity (documents that score 0.5 or more go), language (documents without a letter, or that
resemble no known language, go), near-duplicates (SimHash fingerprints of three-word runs, linked at two
differing bits or fewer; the smallest doc_id of each group stays), packing.
Each stage's rows are written to the shared folder and read again as the next one's documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewframe.llm import langid, packing, simhash, toxicity
from reviewframe.llm.common import stored, table

#: Documents whose n-grams are farther than this from every profile belong to no language we know.
LEAST_LANGUAGE_SCORE = 0.2
#: Words in a run of the SimHash fingerprints, and the most bits in which linked ones differ.
SHINGLE, BITS = 3, 2


def _kept(docs: DataFrame) -> DataFrame:
    """The rows as one column beside their text, so that no column's name can clash with an operator's."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "text")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(_kept(docs), model).where("score < 0.5").select("doc.*")


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    profiles = langid.train(docs)
    if not profiles:
        return docs
    return langid.predict(_kept(docs), profiles).where(
        (F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select("doc.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the row with the smallest doc_id (repeated rows: one of them).

    Different texts under one doc_id are documents of their own; rows without a doc_id stay.
    """
    key = F.xxhash64("doc_id", "text")
    named = docs.where("doc_id IS NOT NULL")
    groups = simhash.near_duplicates(named.select(key.alias("doc_id"), "text"), SHINGLE, BITS).select(
        F.col("doc_id").alias("key"), "component_id").distinct()
    first = named.select(key.alias("key"), F.col("doc_id").alias("id")).join(groups, "key").groupBy("component_id").agg(
        F.min(F.struct("id", "key")).alias("first")).select("first.*")
    rows = _kept(docs).select("doc", F.col("doc.doc_id").alias("id"), F.xxhash64("doc.doc_id", "text").alias("key"))
    kept = rows.join(first, ["id", "key"], "left_semi").dropDuplicates(["id", "key"])
    return kept.unionByName(rows.where("id IS NULL")).select("doc.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("language", drop_unknown_language),
          ("simhash", drop_near_duplicates), ("packing", pack)]

#: The stages' models and fingerprints can't be stated in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
