"""Features of pairs of mentions by what they depend on, against all of them."""

import numpy as np

from glossa.operators import coreference as R


def test_pairs_have_the_scores_and_slopes_of_their_features():
    rng = np.random.default_rng(8)
    for n in (1, 2, 40, 900):
        d = R.Mentions(3, {"head": np.array([f"w{x}" for x in rng.integers(0, 30, n)], object), "kind": np.array(["entity", "noun"], object)[rng.integers(0, 2, n)], "sent_id": np.sort(rng.integers(0, n, n))})
        weights, found, expected = rng.normal(size=1 << 8), np.zeros(1 << 8), np.zeros(1 << 8)
        for k, j, before in d.blocks():
            ids, pairs, gap = R.pair_features(d, j, k, 8), R.Pairs(d, j, k, 8), rng.normal(size=before.shape)
            assert (pairs.scores(weights)[before] == weights[ids].sum(-1)[before]).all()
            pairs.add(found, before, gap)
            np.add.at(expected, ids[before], gap[before][:, None])
        assert np.allclose(found, expected)


def test_learned_clusters_join_no_mentions(spark):
    import __spark_entry__ as entry

    plan = entry.queries()["learned_clusters"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1  # of documents and their languages
