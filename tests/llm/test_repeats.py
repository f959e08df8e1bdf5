"""Operator 11: suffix arrays by induction against sorting, repeats of bytes against plain code."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from glossa.llm import repeats, suffixes

SCHEMA = "doc_id long, text string, row string, kind int"


def plain_suffixes(x):
    x = list(x)
    order = sorted(range(len(x)), key=lambda i: x[i:])
    common = [0]
    for a, b in zip(order, order[1:], strict=False):
        k = 0
        while x[a + k] == x[b + k]:
            k += 1
        common.append(k)
    return order, common


@pytest.mark.parametrize("memory", [3, 11, 64, 1 << 12])
def test_induced_order_and_common_prefixes(memory):
    rng = random.Random(memory)
    for _ in range(120):
        n, alphabet = rng.choice([1, 2, 5, 20, 60, 150]), rng.choice([1, 2, 3, 5, 50, 900])
        x = [rng.randint(1, alphabet) for _ in range(n)]
        x = x[: max(1, n // 3)] * rng.randint(2, 4) if rng.random() < 0.4 else x
        x = np.array([*x, 0], np.int32)
        order, common = suffixes.by_induction(x, memory)
        assert (order.tolist(), common.tolist()) == plain_suffixes(x)
        assert [v.tolist() for v in suffixes._doubled(x)] == list(plain_suffixes(x))


def test_string_far_larger_than_memory():
    words = [bytes(random.Random(k).choices(b"abcdefgh ", k=9)) for k in range(60)]
    text = b"".join(random.Random(3).choices(words, k=6000)) + b"-" * 3000
    x = np.append(np.frombuffer(text, np.uint8).astype(np.uint16) + 2, np.uint16(0))
    order, common = suffixes.by_induction(x, 1 << 11)
    by_doubling = suffixes._doubled(x)
    assert (order == by_doubling[0]).all() and (common == by_doubling[1]).all()


def plain_repeats(rows, window):
    first: dict[bytes, tuple[int, int]] = {}
    for doc, text, *_ in rows:
        raw = (text or "").encode()
        for i in range(len(raw) - window + 1 if doc is not None else 0):
            key = raw[i : i + window]
            first[key] = min(first.get(key, (doc, i)), (doc, i))
    for doc, text, *_ in rows:
        raw = (text or "").encode()
        gone = [False] * len(raw)
        for i in range(len(raw) - window + 1 if doc is not None else 0):
            if first[raw[i : i + window]] < (doc, i):
                gone[i : i + window] = [True] * window
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        yield doc, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()


def corpus(rng):
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(k) for k in (20, 25, 30, 60, 90)]
    line = text(14)
    rows = []
    for i in range(150):
        t = text(rng.randint(0, 40))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 3)
            t += " " + p[a : len(p) - rng.randint(0, len(p) // 3)] + " " + text(rng.randint(0, 20))
        rows.append((i, t + " " + line + " " + text(3), "r", 1))
    rows += [(200 + i, rows[7][1], "r", 1) for i in range(30)]
    rows += [(240, "-" * 700, "r", 1), (241, "ab" * 400 + "x" + "ab" * 90, "r", 1), (242, None, None, None), (243, "", "r", 1), (244, rows[3][1] + rows[3][1], "r", 1)]
    rows += [(245, passages[4], "r", 1), (245, "z" + passages[4], "r", 1), (245, passages[4], "r", 1), (None, passages[4], "r", 1), (None, None, None, None)]
    return rows


@pytest.mark.parametrize("memory,crowd", [(1 << 21, 4096), (1 << 11, 4096), (1 << 21, 8)])
def test_repeats_equal_plain_code(spark, memory, crowd, monkeypatch):
    monkeypatch.setattr(repeats, "MANY", 2)
    rows = corpus(random.Random(crowd))
    got = repeats.deduplicated(spark.createDataFrame(rows, SCHEMA).repartition(3), memory=memory, crowd=crowd)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    got = [tuple(r) for r in got.collect()]
    assert all((kept is None) == (removed == 0) and (kept is None or hashlib.sha256(kept).hexdigest() == digest) for _, _, removed, _, digest, kept in got)
    assert Counter(r[:5] for r in got) == Counter(plain_repeats(rows, 100))


def test_texts_longer_than_a_chunk_and_collections_of_few_pieces(spark, monkeypatch):
    rng = random.Random(4)
    texts = ["".join(rng.choices("abcdefghij", k=3000)) for _ in range(3)]
    data = "".join([texts[0], texts[1][:1500], texts[2], texts[0][700:2500], texts[1][200:1400]]).encode()
    monkeypatch.setattr(repeats, "CHUNK", 1000)
    repeats._tables.cache_clear()
    found = list(repeats.pieces(np.frombuffer(data, np.uint8), np.array([4000, len(data)]), 100))
    repeats._tables.cache_clear()
    windows = sorted(x for at, n, _, _ in found for a, k in zip(at.tolist(), n.tolist(), strict=True) for x in range(a, a + k))
    assert windows == [i for i in range(len(data) - 99) if not 3900 < i < 4000]
    anchors: dict[bytes, set] = {}
    for at, n, m, _ in found:
        for a, k, h in zip(at.tolist(), n.tolist(), m.tolist(), strict=True):
            for x in range(a, a + k):
                anchors.setdefault(data[x : x + 100], set()).add(h)
    assert all(len(v) == 1 for v in anchors.values())


def test_empty_table(spark):
    assert repeats.deduplicated(spark.createDataFrame([], SCHEMA)).count() == 0
