"""The token transforms on a stream of documents: stateless, a micro-batch for each set of new files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glossa.operators.corpus import silver


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema("doc_id bigint, text string, lang string, source string, n_chars bigint").parquet(folder)


def annotated(stream: DataFrame) -> DataFrame:
    """The token table of a stream without the columns that need a window."""
    return silver(stream)


def running_vocabulary(stream: DataFrame) -> DataFrame:
    """Counts of forms so far (complete or update mode); an extension of our own."""
    return silver(stream).groupBy("form").count()
