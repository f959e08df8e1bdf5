"""Operator 6: how many near copies of a corpus the bands and classes find."""

from __future__ import annotations

from collections import defaultdict

import pytest

from glossa.llm import fingerprint


@pytest.fixture(scope="module")
def pairs(spark):
    """Pairs of different texts of sf0.01 with an edit similarity of 0.8 or more, from all that share three runs of three words
    (a text of that similarity shares more) and have 41 to 8,000 characters."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    texts = {r.text: r.doc_id for r in reversed(rows) if r.text and 40 < len(r.text) <= 8000}
    texts = {i: t for t, i in texts.items()}
    shared, runs = defaultdict(int), defaultdict(list)
    for i, t in texts.items():
        words = t.split()
        for g in {tuple(words[k : k + 3]) for k in range(max(1, len(words) - 2))}:
            runs[g].append(i)
    for ids in runs.values():
        if len(ids) < 200:
            for a, i in enumerate(ids):
                for j in ids[a + 1 :]:
                    shared[i, j] += 1
    found = [(i, j) for (i, j), n in shared.items() if n >= 3 and fingerprint.edit_similarity(texts[i], texts[j], 0.8) >= 0.8]
    assert len(found) > 40
    return texts, found


def test_bands_find_near_copies(pairs):
    texts, near = pairs
    keys = {i: set(fingerprint.band_keys(fingerprint.code_points(texts[i])).tolist()) for i in {i for p in near for i in p}}
    assert sum(bool(keys[i] & keys[j]) for i, j in near) >= 0.9 * len(near)


def test_classes_find_near_copies_and_nothing_else(spark, pairs):
    texts, near = pairs
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) between 41 and 8000").select("doc_id", "text")
    of = {r.doc_id: r.class_id for r in fingerprint.near_classes(docs).collect()}
    assert sum(of[i] == of[j] for i, j in near) >= 0.9 * len(near)
    linked = {i for p in near for i in p}
    groups = defaultdict(set)
    for i, c in of.items():
        if i in texts:
            groups[c].add(i)
    assert all(len(g) == 1 or g <= linked for g in groups.values())


def test_bounded_edit_distance():
    a, b = "the quick brown fox jumps over the lazy dog", "a slow green turtle creeps under one busy cat"
    d = fingerprint.edit_distance(a, b)
    assert all((fingerprint.edit_distance(a, b, k) > k) == (d > k) and (d > k or fingerprint.edit_distance(a, b, k) == d) for k in range(60))
