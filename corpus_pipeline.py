"""A corpus pipeline over the documents table: quality, near-duplicates, pseudonyms, mixture, tokens.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a frame that is written and
read again; all but the last return the columns of documents.

Defined cases, for all stages: a null text counts as empty; null ids, languages and sources stay null; texts are taken
whole; an empty table gives an empty one; other columns of docs, whatever their names, are dropped. Repeated rows are
judged each for itself, but of a class of near-duplicates (repeated rows and rows of null ids too) one row stays; rows
without words fall to the quality rules; a document of which the mixture takes two copies stands in its result twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm import bpe, mixing, neardup, pii, quality
from glossa.llm.session import drop_folder, new_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality operator keeps."""
    return quality.judged(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: that of the smallest doc_id (a null one only where there is no other)."""
    return neardup.distinct_documents(docs.select(*COLUMNS))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms for personal data; n_chars is that of the new text."""
    return _documents(pii.pseudonymised(docs.select(*COLUMNS), pii.session_key(spark)))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, as often as it takes at least half of a copy."""
    return mixing.remixed(docs.select(*COLUMNS))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the ids of the text's tokens and their number."""
    return bpe.encode_documents(docs.select("doc_id", "lang", "source", "text"), bpe.vocabulary_path(spark)).drop("text", "decoded")


STAGES = [("quality", quality_rules), ("near-duplicates", near_duplicates), ("pseudonyms", pseudonyms), ("mixture", mixture), ("tokens", tokens)]

#: SQL can express neither the suffix array nor the merges; run()'s rows are tested against plain stages on a fixture.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again; a stage's folder goes when the next is written."""
    return applied(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)


def applied(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All stages over docs; the last folder but one stays, as the result is read from it."""
    before = None
    for name, stage in STAGES[:-1]:
        path = new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            drop_folder(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
