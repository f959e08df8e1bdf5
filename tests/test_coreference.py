"""Antecedents against plain loops, latent learning against numeric slopes."""

from __future__ import annotations

import numpy as np
import pytest

from glossa.operators import coreference as R


def document(n, seed):
    rng = np.random.default_rng(seed)
    words = np.array([f"w{i}" for i in rng.integers(0, 4, n)], object)
    return R.Mentions(seed, {"sent_id": np.sort(rng.integers(0, 5, n)), "start": rng.integers(1, 30, n), "head": words, "kind": np.array(["entity", "noun"], object)[rng.integers(0, 2, n)], "entity": words})


@pytest.mark.parametrize("n", [1, 2, 7, 900])
def test_all_mentions_before_are_candidates(n, monkeypatch):
    monkeypatch.setattr(R, "PAIRS", 4000)
    d = document(n, n)
    s, best = d.columns["start"], []
    for k in range(n):
        options = [(4.0, -1)] + [(float((s[j] * 7 + s[k] * 13 + n) % 17 - min(10, k - j)), j) for j in range(k)]
        best.append(max(options)[1])
    found = R.chosen(d, R.silver_pair, R.silver_new)
    assert found.tolist() == best
    chain = [k for k in range(n)]
    for k in range(n):
        chain[k] = k if best[k] < 0 else chain[best[k]]
    assert R.chain_starts(found).tolist() == chain
    assert sum(int(before.sum()) for _, _, before in d.blocks()) == n * (n - 1) // 2


def test_slope_is_numeric(monkeypatch):
    monkeypatch.setattr(R, "PAIRS", 30)
    d = document(12, 3)
    w = np.random.default_rng(1).normal(size=1 << 8)
    _, slope = R.loss_and_slope(w, d, 8)
    assert np.abs(slope).max() > 0.1
    for row in range(0, 256, 5):
        step = np.zeros_like(w)
        step[row] = 1e-5
        numeric = (R.loss_and_slope(w + step, d, 8)[0] - R.loss_and_slope(w - step, d, 8)[0]) / 2e-5
        assert slope[row] == pytest.approx(numeric, abs=1e-6)


def test_loss_is_that_of_plain_choices():
    d, w = document(6, 9), np.random.default_rng(4).normal(size=1 << 8)
    none, loss = w[R.new_features(d, 8)].sum(1), 0.0
    for k in range(6):
        pairs = [float(w[R.pair_features(d, np.array([j]), np.array([k]), 8)].sum()) for j in range(k)]
        right = [j for j in range(k) if d.columns["entity"][j] == d.columns["entity"][k]]
        every = [none[k] + (R.COSTS["false new"] if right else 0)] + [p + (0 if j in right else R.COSTS["wrong link" if right else "false link"]) for j, p in enumerate(pairs)]
        gold = [pairs[j] for j in right] or [none[k]]
        loss += np.logaddexp.reduce(every) - np.logaddexp.reduce(gold)
    assert R.loss_and_slope(w, d, 8)[0] == pytest.approx(loss)


def test_learned_links(spark):
    rows = []
    for doc in range(30):
        d = document(15, doc)
        rows += [(doc, k + 1, *[v[k].item() if hasattr(v[k], "item") else v[k] for v in d.columns.values()]) for k in range(15)]
    rows.append((None, 1, 0, 1, "x", "noun", "x"))
    table = spark.createDataFrame(rows, "doc_id long, ord int, sent_id int, start int, head string, kind string, entity string")
    packed = R.document_rows(table, "head", "kind", "entity")
    weights = R.trained(packed, rounds=3, learners=2)
    right = lambda w: sum(found[r.doc_id, r.antecedent] == found[r.doc_id, r.k] if r.antecedent else (r.doc_id, found[r.doc_id, r.k]) not in seen[r.doc_id, r.k] for r in R.entity_clusters(packed, *R.scorers(packed, w)).collect())
    found = {(r[0], r[1]): r[-1] for r in rows}
    seen = {(doc, k): {(doc, found[doc, j]) for j in range(1, k)} for doc, k in found}
    assert right(weights) > 0.95 * len(rows) > right(0 * weights)
    assert R.entity_clusters(packed.limit(0)).count() == 0
