import itertools

import numpy as np
import pytest

from glossa.operators import corpus as C
from glossa.operators import decode as D
from glossa.operators.learn import ALGORITHMS, SCHEDULES, SequenceLearner, packed_features, tagged, trained_by_mixing


def trees(n):
    for heads in itertools.product(range(n), repeat=n - 1):
        h = [-1, *heads]
        ok = all(h[m] != m for m in range(1, n))
        for m in range(1, n):
            v, steps = m, 0
            while ok and v and steps <= n:
                v, steps = h[v], steps + 1
            ok = ok and v == 0
        if ok:
            yield h


def total(s, h):
    return sum(s[h[m], m] for m in range(1, len(h)))


def crossing(h):
    arcs = [(min(a, b), max(a, b)) for b, a in enumerate(h) if b]
    return any(a < c < b < d for a, b in arcs for c, d in arcs)


@pytest.mark.parametrize("seed", range(20))
def test_trees(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(2, 6))
    s = rng.integers(-5, 6, (n, n)).astype(float)
    every = list(trees(n))
    best = D.arborescence(s)
    assert best in every and total(s, best) == max(total(s, h) for h in every)
    flat = D.projective(s)
    assert flat in every and not crossing(flat)
    assert total(s, flat) == max(total(s, h) for h in every if not crossing(h))
    p, logz = D.tree_marginals(s)
    w = np.array([np.exp(total(s, h)) for h in every])
    assert np.isclose(logz, np.log(w.sum()))
    assert np.allclose(p[:, 1:].sum(0), 1)
    for m in range(1, n):
        for h in range(n):
            assert np.isclose(p[h, m], sum(x for x, t in zip(w, every) if t[m] == h) / w.sum(), atol=1e-8)


@pytest.mark.parametrize("seed", range(20))
def test_viterbi(seed):
    rng = np.random.default_rng(seed)
    n, k = int(rng.integers(1, 5)), int(rng.integers(1, 4))
    u, p, t = (rng.integers(-9, 3, shape).astype(float) for shape in ((n, k), (k, k), (k, k, k)))
    if seed % 3 == 0 and k > 1:
        p[0, 1] = -np.inf
    first = lambda y: sum(u[i, y[i]] for i in range(n)) + sum(p[y[i], y[i + 1]] for i in range(n - 1))
    second = lambda y: first(y) + sum(t[y[i], y[i + 1], y[i + 2]] for i in range(n - 2))
    every = list(itertools.product(range(k), repeat=n))
    tags, score = D.viterbi(u, p)
    assert first(tags) == score == max(map(first, every))
    tags, score = D.viterbi2(u, p, t)
    assert second(tags) == score == max(map(second, every))


def test_dual_decomposition_is_a_tree_and_no_worse():
    rng = np.random.default_rng(3)
    for _ in range(10):
        n = 5
        s = rng.normal(size=(n, n))
        sib = {(h, a, b): float(rng.normal()) for h in range(n) for a in range(1, n) for b in range(a + 1, n) if h not in (a, b)}
        value = lambda h: total(s, h) + sum(v for (g, a, b), v in sib.items() if h[a] == g and h[b] == g)
        got = D.dual_decomposed(s, sib)
        assert got in list(trees(n)) and value(got) >= value(D.arborescence(s)) - 1e-9


def test_repair_and_simplex():
    assert D.connected({(2, 1), (1, 2)}, 2) == {(2, 1), (1, 2), (0, 1)}
    x = D.simplex(np.array([0.5, 2.0, -1.0]))
    assert np.isclose(x.sum(), 1) and (x >= 0).all() and np.allclose(x, [0, 1, 0])


@pytest.mark.parametrize("seed", range(8))
def test_sequence_marginals(seed):
    rng = np.random.default_rng(seed)
    n, k = int(rng.integers(1, 5)), int(rng.integers(1, 4))
    u, p = rng.normal(size=(n, k)), rng.normal(size=(k, k))
    every = list(itertools.product(range(k), repeat=n))
    w = np.exp([sum(u[i, y[i]] for i in range(n)) + sum(p[a, b] for a, b in zip(y, y[1:])) for y in every])
    node, edge, logz = D.sequence_marginals(u, p)
    assert np.isclose(logz, np.log(w.sum()))
    for i in range(n):
        for t in range(k):
            assert np.isclose(node[i, t], sum(x for x, y in zip(w, every) if y[i] == t) / w.sum())
    for a in range(k):
        for b in range(k):
            assert np.isclose(edge[a, b], sum(x * sum(c == (a, b) for c in zip(y, y[1:])) for x, y in zip(w, every)) / w.sum())


#: A token's tag is its word's, but word 2 continues the tag before it.
ROWS = [(np.array(x), np.ones(len(x), int), np.array(y)) for x, y in [([0, 2, 1], [0, 0, 1]), ([1, 2, 2], [1, 1, 1]), ([0, 0, 1], [0, 0, 1]), ([2, 1], [0, 1]), ([1], [1]), ([0, 1, 2], [0, 1, 1])]]


@pytest.mark.parametrize("algorithm", sorted(ALGORITHMS))
def test_learner_separates(algorithm):
    m = SequenceLearner(2, algorithm, bits=2, rate=1.0, decay=1e-4)
    losses = m.fit(ROWS, 60)
    assert losses[-1] < max(losses[0], 1e-9) or losses[-1] == 0
    w, pair = m.result()
    for ids, _, gold in ROWS:
        assert D.viterbi(w[ids], pair)[0] == gold.tolist()


def test_gradient_steps():
    """Two steps of gradient descent on one token, by hand: probabilities 1/2 first, then those of the shrunk weights."""
    m = SequenceLearner(2, "crf_sgd", bits=1, rate=0.5, schedule="inv", decay=0.2)
    one = (np.array([1]), np.array([1]), np.array([0]))
    assert np.isclose(m.update(*one), np.log(2)) and np.allclose(m.result()[0][1], [0.25, -0.25])
    p = np.exp(0.25) / (np.exp(0.25) + np.exp(-0.25))
    m.update(*one)
    assert np.allclose(m.result()[0][1], 0.25 * (1 - 0.25 * 0.2) * np.array([1, -1]) + 0.25 * (1 - p) * np.array([1, -1]))
    assert [SCHEDULES[s](3, 2) for s in ("fixed", "invsqrt", "inv", "lecun")] == [1, 0.5, 0.25, 0.4]
    with pytest.raises(NotImplementedError):
        SequenceLearner(2, "mira")
    with pytest.raises(ValueError):
        SequenceLearner(2, "svm_mira", schedule="none")


def test_training_in_spark(spark):
    tokens = C.silver(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id % 10 = 0"))
    packed = packed_features(tokens, bits=12).cache()
    labels = sorted(r.tag for r in tokens.select("tag").distinct().collect())
    for algorithm in ("svm_mira", "crf_sgd"):
        model = trained_by_mixing(packed, labels, 2, bits=12, algorithm=algorithm)
        got = tagged(packed, labels, *model)
        assert got.count() == tokens.count() and got.where("tag = predicted").count() > 0.8 * tokens.count()
    none = packed.limit(0)
    assert not trained_by_mixing(none, labels, bits=4)[0].any() and tagged(none, labels, *model).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_labels_along_siblings(spark, seed):
    rng = np.random.default_rng(seed)
    labels = ["a", "b", "c"]
    rows = [(1, h, m, x, float(rng.integers(-4, 5))) for h, ms in ((0, [3]), (3, [1, 2, 5, 6])) for m in ms for x in labels if rng.random() < 0.8 or x == "a"]
    pairs = [(x, y, float(rng.integers(-4, 5))) for x in ["_START_", *labels] for y in [*labels, "_STOP_"] if rng.random() < 0.9]
    scored = spark.createDataFrame([(1, *r) for r in rows], "doc_id long, sent_id long, h int, m int, label string, score double")
    got = {(r.h, r.m): r.label for r in D.labels_along_siblings(scored, spark.createDataFrame(pairs, "left string, right string, score double")).collect()}
    own, near = {(h, m, x): s for _, h, m, x, s in rows}, {(x, y): s for x, y, s in pairs}
    for h in (0, 3):
        ms = sorted({r[2] for r in rows if r[1] == h})
        value = lambda y: sum(own[h, m, x] for m, x in zip(ms, y)) + sum(near.get(p, 0.0) for p in zip(["_START_", *y], [*y, "_STOP_"]))  # noqa: E731, B023
        every = [y for y in itertools.product(labels, repeat=len(ms)) if all((h, m, x) in own for m, x in zip(ms, y))]
        assert value([got[h, m] for m in ms]) == max(map(value, every))


def test_bigrams():
    tags = ["O", "B-X", "I-X", "L-X", "U-X"]
    ok = set(C.allowed_bigrams(tags))
    assert ("B-X", "L-X") in ok and ("B-X", "O") not in ok and (C.START, "I-X") not in ok and ("I-X", C.STOP) not in ok
    assert ("B-X", "O") in set(C.allowed_bigrams(["O", "B-X", "I-X"]))


def test_projective_trees_of_one_length_at_once():
    rng = np.random.default_rng(8)
    for n in (2, 3, 5, 9):
        for limit in (2, n):
            scores = rng.integers(0, 4, (30, n, n)).astype(float)
            far = np.abs(np.arange(n)[:, None] - np.arange(n)) > limit
            far[0] = False
            scores[:, far] = -np.inf
            assert D.projective_many(scores).tolist() == [D.projective(x) for x in scores]
