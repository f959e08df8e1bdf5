"""The part and tree queries over sentences of all lengths, against brute force."""

import itertools
import math

import numpy as np
import pytest

from glossa.operators import decode as D
from glossa.operators import corpus as C
from pyspark.sql import functions as F

LENGTHS = [1, 5, 9, 13, 30]


@pytest.fixture(scope="module")
def tokens(spark):
    """Sentences of these lengths with a binary tree as heads."""
    text = " ".join(" ".join(f"w{i}" for i in range(n - 1)) + (" end." if n > 1 else "end.") for n in LENGTHS)
    docs = spark.createDataFrame([(3, text, "en", "a"), (4, None, "en", "a")], "doc_id long, text string, lang string, source string")
    return C.silver(docs).withColumn("head", F.floor(F.col("tok_id") / 2).cast("int")).cache()


def arcs(n):
    return [(h, m, int(h == m // 2)) for m in range(1, n + 1) for h in range(n + 1) if h != m]


def score(h, m, gold):
    return (h * 7 + m * 13 + 3) % 17 + gold * 5


def up(m):
    return [m >> d for d in range(1, m.bit_length() + 1)]


def softmax(n):
    out = []
    for m in range(1, n + 1):
        s = {h: score(h, k, g) for h, k, g in arcs(n) if k == m}
        z = sum(math.exp(v) for v in s.values())
        out += [(h, m, math.exp(v) / z, v, max(s.values())) for h, v in s.items()]
    return out


def ranked(n):
    for m in range(1, n + 1):
        best = sorted((-v, h, v, top) for h, k, _, v, top in softmax(n) if k == m)[:3]
        yield from ((m, h, i) for i, (_, h, v, top) in enumerate(best, 1) if i == 1 or math.exp(v - top) >= 0.001)


def crossed(n):
    bad = [m for m in range(2, n + 1) if any(m // 2 not in up(k) for k in range(m // 2 + 1, m))]
    return [(len(bad),)] if bad else []


PAIRS = {
    "sibling_parts": (lambda a, b: a[0] == b[0] and a[1] < b[1], lambda a, b: (a[0], a[1], b[1])),
    "grandparents": (lambda a, b: a[1] == b[0] and a[0] != b[1], lambda a, b: (a[0], b[0], b[1])),
    "head_bigrams": (lambda a, b: a[1] + 1 == b[1], lambda a, b: (b[0], b[1], a[0])),
    "coparents": (lambda a, b: a[1] == b[1] and a[0] < b[0], lambda a, b: (a[0], b[0], a[1])),
}
BRUTE = {
    "ancestors": lambda n: [(m, a, d) for m in range(1, n + 1) for d, a in enumerate(up(m), 1)],
    "nonprojective_arcs": crossed,
    "arc_candidates": arcs,
    "label_argmax": lambda n: [(m, h, float(score(h, m, h == m // 2))) for m, h, i in ranked(n) if i == 1],
    "label_marginals": lambda n: [(h, m, round(p, 6)) for h, m, p, *_ in softmax(n)],
    "topk_heads": lambda n: list(ranked(n)),
} | {k: lambda n, on=on, cols=cols: [(*cols(a, b), a[2] * b[2]) for a in arcs(n) for b in arcs(n) if on(a, b)] for k, (on, cols) in PAIRS.items()}


def scored(t):
    return C.silver_scores(C.arc_candidates(t))


OPERATORS = {
    "ancestors": C.ancestors,
    "nonprojective_arcs": lambda t: C.nonprojective(t.where("head > 0"), C.ancestors(t)).groupBy("doc_id", "sent_id").agg(F.count("*").alias("n")),
    "arc_candidates": C.arc_candidates,
    "label_argmax": lambda t: C.best_heads(scored(t)),
    "label_marginals": lambda t: C.marginals(scored(t)).select("doc_id", "sent_id", "h", "m", F.round("p", 6).alias("p")),
    "topk_heads": lambda t: C.top_heads(scored(t), 3, 0.001).select("doc_id", "sent_id", "m", "h", "rank"),
    "sibling_parts": lambda t: C.sibling_parts(C.arc_candidates(t)),
    "grandparents": lambda t: C.grandparent_parts(C.arc_candidates(t)),
    "head_bigrams": lambda t: C.head_bigram_parts(C.arc_candidates(t)),
    "coparents": lambda t: C.coparent_parts(C.arc_candidates(t)),
    "chu_liu_edmonds": lambda t: D.parsed(scored(t)),
    "eisner": lambda t: D.parsed(scored(t), D.projective),
}


@pytest.mark.parametrize("name", BRUTE)
def test_parts_of_all_sentences(tokens, name):
    got = OPERATORS[name](tokens)
    values = [c for c in got.columns if c not in ("doc_id", "sent_id")]
    rows = lambda rs: sorted((s, *(round(float(v), 5) for v in vs)) for s, vs in rs)
    assert rows((r.sent_id, [r[c] for c in values]) for r in got.collect()) == rows((s, v) for s, n in enumerate(LENGTHS) for v in BRUTE[name](n))


@pytest.mark.parametrize("name", ["chu_liu_edmonds", "eisner"])
def test_trees_of_all_sentences(tokens, name):
    got = {(r.sent_id, r.m): r.h for r in OPERATORS[name](tokens).collect()}
    assert sorted(got) == [(s, m) for s, n in enumerate(LENGTHS) for m in range(1, n + 1)]
    for s, n in enumerate(LENGTHS):
        for m in range(1, n + 1):
            v, steps = m, 0
            while v and steps <= n:
                v, steps = got[s, v], steps + 1
            assert v == 0
        if n == 5:
            value = lambda hs: sum(score(h, m, h == m // 2) for m, h in enumerate(hs, 1))
            best = max(value(hs) for hs in itertools.product(range(6), repeat=5) if tree(hs) and (name != "eisner" or flat(hs)))
            assert value([got[s, m] for m in range(1, 6)]) == best


def tree(hs):
    for m in range(1, len(hs) + 1):
        v = m
        for _ in hs:
            v = v and hs[v - 1]
        if v or hs[m - 1] == m:
            return False
    return True


def flat(hs):
    spans = [(min(a, b), max(a, b)) for b, a in enumerate(hs, 1)]
    return not any(a < c < b < d for a, b in spans for c, d in spans)


def test_many_cycles_in_a_long_sentence():
    n = 2402  # pairs of tokens that prefer each other: 1200 cycles
    s = np.zeros((n + 1, n + 1))
    for m in range(1, n, 2):
        s[m, m + 1] = s[m + 1, m] = 5
    heads = D.arborescence(s)
    assert sum(s[h, m] for m, h in enumerate(heads) if m) == 5 * n / 2
    assert tree(heads[1:])
