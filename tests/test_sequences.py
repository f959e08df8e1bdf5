"""Tagging inside tasks against features, lattices and learners over token tables."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from glossa.functions import aligned as AL
from glossa.operators import corpus as C
from glossa.operators import decode as D
from glossa.operators import flat
from glossa.operators import learn as L
from glossa.operators import sequences as Q


def test_hashes_are_those_of_spark(spark):
    words = ["", "a", "été", "x" * 3, "abcd", "abcdefg", "12345678", "y" * 31, "z" * 32, "w" * 77, "日本語" * 9]
    expected = [r[0] for r in spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string").orderBy("i").select(F.xxhash64(F.concat(F.lit("w:"), "w"))).collect()]
    assert Q.hashes(pa.array(words), "w:").tolist() == expected


def test_features_and_labels_are_those_of_token_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(15)
    t = C.typed_tags(C.silver(docs), "tag", ["PROP", "NUM"])
    expected = {(r.doc_id, r.sent_id): (r.ids, r.counts, r.tags) for r in L.packed_features(t.withColumn("tag", F.col("bio"))).collect()}
    labels, found = ["B-NUM", "B-PROP", "I-NUM", "I-PROP", "O"], {}
    for b in docs.select("doc_id", "text").toArrow().combine_chunks().to_batches():
        for _, x in flat.slices(b, 20_000):
            ids, gold = Q.feature_ids(x), Q.entity_labels(labels)(x)
            for k, (a, z) in enumerate(zip(x.offset[:-1], x.offset[1:], strict=True)):
                own = ids[a:z]
                found[int(x.doc[k]), int(x.sent_id[k])] = (own[own >= 0].tolist(), (own >= 0).sum(1).tolist(), [labels[g] for g in gold[a:z]])
    assert found == expected


def test_best_paths_are_those_of_viterbi():
    rng = np.random.default_rng(5)
    for n in (1, 2, 6):
        unary, pair = rng.integers(-2, 3, (40, n, 4)).astype(float), rng.integers(-1, 2, (4, 4)).astype(float)
        tags, value = Q.best_paths(unary, pair)
        for u, own, v in zip(unary, tags.tolist(), value.tolist(), strict=True):
            assert (own, v) == D.viterbi(u, pair)


@pytest.mark.parametrize("name", ["perceptron_tagger", "constrained_entities"])
def test_tokens_are_not_packed_by_shuffles(spark, name):
    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "Window" not in plan and "Join" not in plan


def test_aligned_sentences_need_no_rows_of_tokens(spark):
    plan = entry.queries()["aligned_treebank"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan


def test_plain_sentences_have_the_tokens_of_the_rules():
    rng = np.random.default_rng(2)
    pieces, plain = ["a", "B.", ".", ",", "?", "!", "...", "--", "-", " ", "  ", "\n", "\t", "cannot", "Wanna", "x", "3", "%", "'", '"', "(", "é", ":", "\x0b"], 0
    for _ in range(20_000):
        s = "".join(rng.choice(pieces, rng.integers(1, 9)))
        found = AL.plain_treebank(s)
        if found is not None:
            plain += 1
            assert found == [f for f, _, _ in AL.treebank(s)], s
            assert all(f == s[a:z] for f, a, z in AL.treebank(s)), s
    assert plain > 1000
