"""Lexicons as tables: gazetteers, lemmas, tag lists, pronouns, gender counts; and settings by language.

Line readers ignore blank lines. A line with too few fields is an error that names the file's kind.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("value")).where(F.trim("value") != "")


def _field(parts: Column, i: int, kind: str) -> Column:
    return F.when(F.size(parts) > i, F.get(parts, F.lit(i))).otherwise(F.raise_error(F.concat(F.lit(f"{kind}: too few fields in "), F.col("value"))))


def read_gazetteer(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """type, words of lines `TYPE w1 w2 ...`; the words' tags are `corpus.gazetteer_tags`."""
    parts = F.filter(F.split("value", r"[ \t]+"), lambda w: w != "")
    return _lines(spark, path).select(_field(parts, 0, "gazetteer").alias("type"), F.slice(parts, F.lit(2), F.size(parts)).alias("words"))


def read_phrase_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """type, words of files of phrases, one a line; a file's name without ending is its type."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file")).where(F.trim("value") != "")
    return rows.select(F.regexp_replace("file", r"\.[^.]*$", "").alias("type"), F.filter(F.split("value", r"[ \t\r]+"), lambda w: w != "").alias("words"))


def read_lemmas(spark: SparkSession, path: str) -> DataFrame:
    """word, tag, lemma of tab-separated lines; of a word and tag given twice the lemma that sorts first."""
    parts = F.split("value", "\t", -1)
    rows = _lines(spark, path).select(*[_field(parts, i, "lemmas").alias(c) for i, c in enumerate(("word", "tag", "lemma"))])
    return rows.groupBy("word", "tag").agg(F.min("lemma").alias("lemma"))


def read_tags(spark: SparkSession, path: str) -> DataFrame:
    """tag: the tags that an unknown word may have, one a line."""
    return _lines(spark, path).select(F.trim("value").alias("tag")).distinct()


def read_pronouns(spark: SparkSession, path: str) -> DataFrame:
    """form, person, number, gender of lines `form TAB code`."""
    from glossa.operators.semantics import pronoun_flags

    parts = F.split("value", "\t", -1)
    rows = _lines(spark, path).select(_field(parts, 0, "pronouns").alias("form"), _field(parts, 1, "pronouns").alias("code"))
    return rows.select("form", *pronoun_flags(F.col("code")))


def read_mention_tags(spark: SparkSession, path: str) -> DataFrame:
    """kind, tags of lines `kind TAB tag TAB tag ...`."""
    parts = F.split("value", "\t", -1)
    return _lines(spark, path).select(_field(parts, 0, "mention tags").alias("kind"), F.slice(parts, F.lit(2), F.size(parts)).alias("tags"))


def read_gender_counts(spark: SparkSession, path: str) -> DataFrame:
    """phrase, male, female, neutral, plural of lines `phrase TAB m f n p`; counts of a phrase given twice are added."""
    parts = F.split("value", "\t", -1)
    rows = _lines(spark, path).select(_field(parts, 0, "gender counts").alias("phrase"), F.split(F.trim(_field(parts, 1, "gender counts")), r"[ \t]+").alias("n"))
    return rows.groupBy("phrase").agg(*[F.sum(F.get("n", F.lit(i)).cast("long")).alias(c) for i, c in enumerate(("male", "female", "neutral", "plural"))])


def phrase_counts(mentions: DataFrame, counts: DataFrame) -> DataFrame:
    """mentions (words, head_word) with number and gender: by the whole phrase where the counts have it, else by its head word.

    Mentions in neither are singular and of unknown gender.
    """
    from glossa.operators.semantics import number_and_gender

    known = number_and_gender(counts).select("phrase", "number", "gender")
    whole = known.select(F.col("phrase").alias("p1"), F.col("number").alias("n1"), F.col("gender").alias("g1"))
    single = known.select(F.col("phrase").alias("p2"), F.col("number").alias("n2"), F.col("gender").alias("g2"))
    rows = mentions.join(whole, F.array_join("words", " ") == F.col("p1"), "left").join(single, F.col("head_word") == F.col("p2"), "left")
    return rows.select(*mentions.columns, F.coalesce("n1", "n2", F.lit("singular")).alias("number"), F.coalesce("g1", "g2", F.lit("unknown")).alias("gender"))


def settings(text: str) -> dict[str, dict[str, str]]:
    """Settings by language of a text of blocks of lines key="value", parted by blank lines; each block names its language.

    Lines that begin with # are comments. A block without a language, or two of one, are errors.
    """
    out: dict[str, dict[str, str]] = {}
    for block in re.split(r"\n[ \t]*\n", text.replace("\r\n", "\n")):
        rows = [x for x in block.split("\n") if x.strip() and not x.lstrip().startswith("#")]
        found = [re.fullmatch(r'\s*([\w.-]+)\s*=\s*"([^"]*)"\s*', x) for x in rows]
        if bad := [x for x, m in zip(rows, found, strict=True) if not m]:
            raise ValueError(f"not a setting: {bad[0]}")
        block_settings = {m[1]: m[2] for m in found if m}
        if not block_settings:
            continue
        language = block_settings.pop("language", None)
        if not language or language in out:
            raise ValueError(f"a block needs a language of its own, not {language}")
        out[language] = block_settings
    return out
