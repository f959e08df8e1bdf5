"""Learners in step against learners of their own."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossa.operators import decode as D
from glossa.operators import learn as L
from glossa.operators import lockstep as K
from glossa.operators import sequences as Q
from glossa.operators.corpus import SENT

LABELS = ["FUNC", "NOUN", "NUM", "PROP", "PUNC", "VERB", "WORD"]


@pytest.mark.parametrize("algorithm", sorted(L.ALGORITHMS))
def test_learners_in_step_learn_what_each_learns_alone(algorithm):
    rng = np.random.default_rng(3)
    n = np.append(rng.integers(1, 9, 90), [1, 40, 1, 70])
    offset = np.append(0, np.cumsum(n))
    ids, gold, who = rng.integers(-1, 16, (offset[-1], 4)), rng.integers(0, 3, offset[-1]), rng.integers(0, 5, len(n))
    ids[:, 0] = 0
    how = {"decay": 0.01} if algorithm.endswith("sgd") else {}
    some = K.Lockstep(6, 3, algorithm, bits=4, **how)  # the last sees nothing
    for a, z in ((0, 50), (50, len(n))):
        some.fit(ids[offset[a] : offset[z]], gold[offset[a] : offset[z]], offset[a : z + 1] - offset[a], who[a:z])
    weights, pair = np.zeros((16, 3)), np.zeros((3, 3))
    for g in range(5):
        one = L.SequenceLearner(3, algorithm, bits=4, **how)
        for j in np.flatnonzero(who == g):
            own = ids[offset[j] : offset[j + 1]]
            one.update(own[own >= 0], (own >= 0).sum(1), gold[offset[j] : offset[j + 1]])
        weights, pair = weights + one.result()[0], pair + one.result()[1]
    found = some.totals()
    assert np.allclose(found[0], weights, atol=1e-9) and np.allclose(found[1], pair, atol=1e-9) and found[2] == 5 and weights.any()


def test_marginals_take_no_logarithm_a_place(monkeypatch):
    rng = np.random.default_rng(4)
    for n, size in ((1, 1.0), (7, 30.0), (300, 20.0)):
        u, p = rng.normal(size=(n, 4)) * size, rng.normal(size=(4, 4)) * size
        slow = D.sequence_marginals(np.concatenate([u, np.full((n, 1), -np.inf)], 1), np.pad(p, (0, 1)))
        with monkeypatch.context() as m:
            m.delattr(np, "logaddexp")
            node, edge, logz = D.sequence_marginals(u, p)
        assert np.allclose(node, slow[0][:, :4]) and np.allclose(edge, slow[1][:4, :4]) and np.isclose(logz, slow[2])


def test_learners_that_share_tasks_give_the_same_model(spark):
    """Eleven learners on fewer cores: the model is that of eleven tasks over packed token tables' features."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40)
    gold = {}
    weights, pair = Q.trained(docs, LABELS, Q.tag_labels, learners=11, bits=18, algorithm="crf_sgd")
    rows = Q.sentence_texts(docs).withColumn("own", F.pmod(F.hash(*SENT), F.lit(11))).orderBy("own", *SENT).toArrow().combine_chunks()
    for b in rows.to_batches():
        for part, t in Q.flat.slices(b, Q.SIZE):
            ids, right = Q.feature_ids(t), Q.tag_labels(t)
            for g, a, z in zip(part.column("own").to_numpy()[t.row].tolist(), t.offset[:-1], t.offset[1:], strict=True):
                one = gold.setdefault(g, L.SequenceLearner(7, "crf_sgd"))
                one.update(ids[a:z][ids[a:z] >= 0], (ids[a:z] >= 0).sum(1), right[a:z])
    models = [x.result() for x in gold.values()]
    assert np.allclose(weights, sum(m[0] for m in models) / len(models)) and np.allclose(pair, sum(m[1] for m in models) / len(models))
