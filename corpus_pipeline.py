"""Corpus pipeline over ``documents``: each stage works on all that the one before has kept.

language   documents whose language is rejected (no letter, or unlike every learnt language) go
near_copy  one document of each group of near copies stays, the one with the smallest id
benchmark  documents that hold a test item go
secrets    secrets are replaced by their kind in brackets; n_chars follows
bpe        whole texts become tokens; the ids, their digest and that of the decoded text are returned

All stages but the last return the columns of ``documents``.  Null ids can't be told apart and go in
the second stage; null texts have no letter and go in the first.  An id that is repeated has one row from the
second stage on.  Extra columns are carried along; an empty table gives none.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from standspark.llm import bpe, common, decontaminate, jaccard, langid, secrets


def _only(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    name = "_chosen"
    while name in docs.columns:
        name += "_"
    return docs.join(ids.select(F.col("doc_id").alias(name)).distinct(), docs["doc_id"] == F.col(name), how)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification doesn't reject."""
    rejected = langid.identify(docs).where("rejected").select("doc_id")
    return _only(docs, rejected, "left_anti").where("text IS NOT NULL")


def near_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies, one row of each document."""
    found = jaccard.similar_components(docs)
    kept = _only(docs, found.where("doc_id = component_id"), "left_semi")
    # Rows that repeat an id are one document; of different texts the least stays.
    others = [c for c in docs.columns if c != "doc_id"]
    first = kept.groupBy("doc_id").agg(F.min_by(F.struct(*others), F.struct("text", "lang", "source", "n_chars")).alias("_row"))
    return first.select(*(F.col("doc_id") if c == "doc_id" else F.col("_row")[c].alias(c) for c in docs.columns))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a test item."""
    found = decontaminate.contaminated(docs, common.table(spark, sf_dir, "benchmark"))
    return _only(docs, found.select("doc_id"), "left_anti")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced."""
    names = docs.columns
    clean = secrets.redacted(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*names)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, ids_sha256, decoded_sha256 of every document."""
    return bpe.round_trip(docs, bpe.default_path(), keep_ids=True)


STAGES = [("language", language), ("near_copy", near_copy), ("benchmark", benchmark), ("secrets", secret_scan), ("bpe", tokens)]

#: Language models, near copies and tokens have no form in SQL; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = common.keep(stage(spark, docs, sf_dir))
    return docs
