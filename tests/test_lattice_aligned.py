"""Lattice decoding against enumeration, aligned tokenisation against the column functions."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossa.functions import aligned as AL
from glossa.functions import text as X
from glossa.operators import lattice as V
from glossa.operators import learn as L


@pytest.mark.parametrize("seed", range(25))
def test_best_path_equals_enumeration(seed):
    rng = np.random.default_rng(seed)
    n, k = int(rng.integers(1, 5)), int(rng.integers(1, 5))
    unary, pair = rng.integers(-9, 9, (n, k)).astype(float), rng.integers(-9, 9, (k, k)).astype(float)
    pair[rng.random((k, k)) < 0.3] = -np.inf
    allowed = [np.sort(rng.choice(k, int(rng.integers(1, k + 1)), replace=False)) for _ in range(n)]
    total = lambda p: sum(unary[i, x] for i, x in enumerate(p)) + sum(pair[a, b] for a, b in zip(p, p[1:], strict=False))
    best = max(map(total, itertools.product(*[a.tolist() for a in allowed])))
    path = V.best_path(unary, pair, allowed)
    assert (path is None) == (best == -np.inf)
    assert path is None or (total(path) == best and all(x in a for x, a in zip(path, allowed, strict=True)))


def test_legal_pairs_of_schemes():
    bio, first, last = V.legal_pairs(["B-X", "B-Y", "I-X", "O"])
    assert np.isneginf(bio[3, 2]) and np.isneginf(bio[1, 2]) and bio[0, 2] == bio[2, 2] == bio[2, 3] == 0
    assert first.tolist() == [0, 0, -np.inf, 0] and last.tolist() == [0, 0, 0, 0]
    bilou, first, last = V.legal_pairs(["B-X", "I-X", "L-X", "O", "U-X"])
    assert np.isneginf(bilou[0, 3]) and bilou[0, 2] == bilou[2, 0] == 0 and np.isneginf(last[0]) and last[2] == 0 and np.isneginf(first[2])


def test_no_illegal_pair_and_no_label_outside(spark):
    labels = ["B-X", "I-X", "O"]
    words = lambda s: "aa ab b aa b".split() + (["ab"] if s > 2 else [])  # noqa: E731  with ab at the end no path is legal
    tokens = spark.createDataFrame([(1, s, i + 1, w, t) for s in range(6) for i, (w, t) in enumerate(zip(words(s), ["B-X", "I-X", "O", "B-X", "O", "B-X"], strict=False))], "doc_id long, sent_id int, tok_id int, form string, tag string")
    packed = L.packed_features(tokens)
    rng = np.random.default_rng(0)
    weights, pair = rng.normal(size=(1 << L.BITS, 3)), rng.normal(size=(3, 3))
    seen = V.seen_labels(tokens.where("form <> 'ab' or tag = 'I-X'"), "form", "tag")
    got = V.tagged(V.with_lattice(packed, tokens, seen, "form"), labels, weights, pair).orderBy("sent_id", "tok_id").collect()
    allowed = {r.form: r.allowed for r in seen.collect()}
    assert len(got) == 3 * 5 + 3 * 6 and all(r.predicted in labels for r in got)
    assert all(r.predicted in allowed[words(r.sent_id)[r.tok_id - 1]] for r in got if r.sent_id <= 2)
    assert all(not (b.predicted == "I-X" and a.predicted == "O") for a, b in zip(got, got[1:], strict=False) if b.tok_id > 1)


TEXTS = ['He said "I can\'t go," didn\'t he?', "I cannot  wanna gimme d'ye 'tis more'n -- (x) [y]...", "«Oui», l'ami d'été 3:45 a:b --- c", "“Ja”, sagte er; 'nein'.", "a--b \"c\" 10,000 $5 & co. éé 😀 x.", "''", '"', " tabs\tand \n lines "]


@pytest.mark.parametrize("how", ["treebank", "universal"])
def test_aligned_tokens_are_the_column_functions(spark, how):
    langs = ["en", "de", "fr", "pt-cintil", "en-ptb", "es"]
    rows = [(i, lang, j, t) for j, t in enumerate(TEXTS) for i, lang in enumerate(langs)]
    sents = spark.createDataFrame(rows, "doc_id long, lang string, sent_id int, sentence string")
    column = X.treebank(F.col("sentence")) if how == "treebank" else X.universal(F.col("sentence"), F.col("lang"))
    want = {(r.doc_id, r.sent_id): r.forms for r in sents.select("doc_id", "sent_id", column.alias("forms")).collect()}
    got: dict = {}
    for r in AL.aligned_tokens(sents, getattr(AL, how)).orderBy("doc_id", "sent_id", "tok_id").collect():
        got.setdefault((r.doc_id, r.sent_id), []).append((r.form, r.start, r.end))
    for key, forms in want.items():
        found, text = got.get(key, []), TEXTS[key[1]]
        assert [f for f, _, _ in found] == forms
        for form, start, end in found:
            assert 0 <= start <= end <= len(text)
            if not set(form) & set("`'\""):
                assert text[start:end].replace(" ", "") == form or form in ("--",)
        assert [s for _, s, _ in found] == sorted(s for _, s, _ in found)
