"""Rows of tag bigrams from sums of words against joins of tokens."""

import __spark_entry__ as entry
from glossa.operators import corpus as C
from glossa.operators import words as W
from test_words import TEXTS


def test_bigram_rows_are_those_of_joins(spark):
    rows = [(k * 7 - 3, "en", x) for k, x in enumerate(TEXTS * 3)] + [(None, "de", "Der Tag. der house stands Tag tag"), (99, "de", "A"), (98, "en", "x 3 tag Tag Der")]
    docs = spark.createDataFrame(rows, "doc_id bigint, lang string, text string").coalesce(1)
    t = C.silver(docs)
    expected, found = C.bigram_parts(C.unigram_parts(t, C.allowed_tags(t))), W.bigram_rows(docs)
    assert found.columns == expected.columns and [k for _, k in found.dtypes] == [k for _, k in expected.dtypes]
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect()))
    assert W.bigram_rows(docs.where("false")).count() == 0


def test_tokens_are_not_joined(spark):
    plan = entry.queries()["bigram_parts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "collect_set" not in plan
