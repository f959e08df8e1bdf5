"""Arcs over tokens that don't descend from the head: in tasks against joins of tokens."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import __spark_entry__ as entry
from glossa.operators import corpus as C
from glossa.operators import flat
from glossa.operators import inrow as I


def test_crossed_arcs_are_those_of_joins(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    docs = docs.unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    t = C.silver(docs)
    expected = C.nonprojective(t.where("head > 0"), C.ancestors(t)).groupBy("doc_id", "sent_id").agg(F.count("*").alias("n"))
    found = I.crossed_arcs(docs)
    assert found.dtypes == expected.dtypes
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, expected.collect()), key=repr)


def test_any_heads_count(monkeypatch, spark):
    """Heads to both sides, far ones, and a cycle."""
    heads = [[3, 0, 5, 1, 0], [0, 4, 1, 1, 2, 3], [2, 1, 0, 1], [0]]
    made = []
    monkeypatch.setattr(I, "on_texts", lambda docs, schema, run: made.append(run))
    I.crossed_arcs(None)
    n = np.array([len(x) for x in heads])
    t = flat.annotated(pa.array(["x " * k for k in n], pa.large_string()), pa.array(range(len(heads)), pa.int64()))
    t.head = np.concatenate(heads)
    ids, _, count = made[0](t)

    def above(own, k):
        out = set()
        while own[k - 1] and own[k - 1] not in out:
            k = own[k - 1]
            out.add(k)
        return out

    expected = [sum(any(h not in above(own, k) for k in range(min(m, h) + 1, max(m, h))) for m, h in enumerate(own, 1) if h) for own in heads]
    assert dict(zip(ids.to_pylist(), count.tolist())) == {k: x for k, x in enumerate(expected) if x} and expected[0]


def test_no_token_is_shuffled(spark):
    plan = entry.queries()["nonprojective_arcs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
