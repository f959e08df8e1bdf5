"""Sums of words over buckets of documents against the joins of all tokens that they stand for."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from glossa.operators import corpus as C
from glossa.operators import learn as L
from glossa.operators import parts as P
from glossa.operators import words as W

TEXTS = ["The house stands. House and _START_ end! 12 Houses, the x.", "Stands the _STOP_ house? a", "One\x01Two houses stands é été Été", "", None, "The house. The the -- x-y 3.5 A"]


@pytest.fixture
def docs(spark):
    rows = [(k * 7 - 3, "en", x) for k, x in enumerate(TEXTS * 3)] + [(None, "de", "Der Tag. der tag")]
    return spark.createDataFrame(rows, "doc_id bigint, lang string, text string").coalesce(1)


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("order", [2, 3])
def test_tag_parts_are_those_of_joins(spark, docs, order):
    t = C.silver(docs).where("doc_id is not null")
    unigrams = C.unigram_parts(t, C.allowed_tags(t))
    parts = C.bigram_parts(P.with_boundaries(unigrams)) if order == 2 else P.trigram_parts(unigrams)
    keys = [f"t{k}" for k in range(1, order + 1)]
    expected = parts.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("gold").alias("n_gold"))
    assert _rows(W.tag_parts(docs.where("doc_id is not null"), order)) == _rows(expected)


def test_count_scores_are_those_of_joins(spark, docs):
    f = L.feature_rows(C.silver(docs).where("doc_id is not null"))
    expected = L.best_labels(L.scored(f, L.count_weights(f))).withColumn("score", F.col("score").cast("long"))
    assert _rows(W.count_scores(docs.where("doc_id is not null"))) == _rows(expected)


def test_one_bucket_alone_and_none(spark, docs):
    """A word of one bucket has no sum to get; no document, no rows."""
    one = docs.where("doc_id = 4").coalesce(1)
    assert sum(r.n_gold for r in W.tag_parts(one, 2).collect()) == sum(r.n + 1 for r in C.silver(one).select("sent_id", "n").distinct().collect())
    assert W.count_scores(docs.where("false")).count() == 0


@pytest.mark.parametrize("name", ["linear_scores", "bounded_bigram_parts", "trigram_parts"])
def test_tokens_are_not_joined(spark, name):
    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "explode" not in plan
