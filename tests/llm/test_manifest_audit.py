"""Operators 12 and 13 against plain code: nulls, ties, repeated rows, forced collisions and small buckets."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from glossa.llm import audit, manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, path string, mask int"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def grown(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def runs(levels, i):
    for level in levels[:-1]:
        yield i % 8, level[i // 8 * 8 : i // 8 * 8 + 8]
        i //= 8


def leaf(r, low=False):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), r[1]) if low and r[1] is not None else r[1]
    return sha(field(r[0]), field(r[3]), field(r[2]), field(r[4]), field(text))


def plain_manifest(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[2]].append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        by[lang].sort(key=lambda r: (-(1 << 63) if r[0] is None else r[0], leaf(r)))
        trees[lang] = grown([leaf(r) for r in by[lang]])
    top = grown([trees[x][-1][0] for x in langs])
    for k, lang in enumerate(langs):
        for i, r in enumerate(by[lang]):
            path = [*runs(trees[lang], i), *runs(top, k)]
            x = leaf(r, r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0)
            for at, run in path:
                x = sha(*[x if j == at else h for j, h in enumerate(run)])
            root = top[-1][0]
            yield r[0], leaf(r), trees[lang][-1][0], root, sha(*[h for at, run in path for j, h in enumerate(run) if j != at]), x, x == root


def documents():
    rows = [(i, f"Text {i % 700} of A row", ("en", "de", None, "", "fr", "é")[min(i % 13, 5)], "s", 3, "x", 1) for i in range(1400)]
    rows += [(7, t, "en", None, None, "x", 1) for t in ("Q", "", None, "q", *["Again"] * 620)]
    rows += [(None, "Nobody's", "en", "s", 1, "x", 1), (None, None, None, None, None, None, None), (-5, "below zero", "de", "s", 2, "x", 1), (2, "alone", "zz", "s", 2, "x", 1), (2**62, "far", "de", "é", 2, "x", 1)]
    rows += [(1, str(k), f"l{k:02d}", "s", 1, "x", 1) for k in range(20)]
    return rows


@pytest.mark.parametrize("begin,bucket", [(manifest.BEGIN, manifest.BUCKET), (2, 3)])
def test_manifest_equals_plain_trees(spark, begin, bucket):
    rows = documents()
    got = manifest.manifest(spark.createDataFrame(rows, SCHEMA), begin, bucket)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert Counter(map(tuple, got.collect())) == Counter(plain_manifest(rows))


def test_manifest_of_an_empty_table_and_of_one_row(spark):
    assert manifest.manifest(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(3, "One", None, None, None, None, None)]
    assert [tuple(r) for r in manifest.manifest(spark.createDataFrame(rows, SCHEMA)).collect()] == list(plain_manifest(rows))


def plain_masks(rows):
    ids = defaultdict(set)
    for r in rows:
        if r[0] is not None:
            ids[r[1] or ""].add(r[0])
    out = []
    for r in rows:
        text = r[1] or ""
        words = re.findall("[^\x20\x09-\x0d]+", text)
        out.append((len(words) < 200) + 2 * (100 * len(set(words)) < 50 * len(words)) + 4 * (100 * len(re.findall("[A-Z]", text)) > 2 * len(text)) + 8 * bool(re.search("[#$%&*|]", text)) + 16 * (r[0] is not None and min(ids[text]) < r[0]))
    return out


def plain_audit(rows, labels):
    told = {name: {d for d, q, t in labels if (q, t)[k] == 1 and d is not None} for k, name in enumerate(("good", "toxic"))}
    masks, out = plain_masks(rows), {}
    shapley = Counter()
    for order in permutations("ABCDE"):
        for step in range(1, 6):
            own, before = 1 << "ABCDE".index(order[step - 1]), sum(1 << "ABCDE".index(x) for x in order[: step - 1])
            for part in {r[3] or "" for r in rows}:
                c = Counter()
                for r, m in zip(rows, masks, strict=True):
                    if (r[3] or "") == part:
                        gone = bool(m & own) and not m & before
                        c.update(kept=not m & (own | before), removed=gone, redundant=bool(m & own and m & before), unique_fails=m == own, good_lost=gone and r[0] in told["good"], toxic_lost=gone and r[0] in told["toxic"])
                out[part, "".join(order), step] = [c[k] for k in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")]
                shapley[part, own] += c["removed"]
    return {(*k, *v, shapley[k[0], 1 << "ABCDE".index(k[1][k[2] - 1])]) for k, v in out.items()}


def audit_rows():
    long = " ".join(f"w{i}" for i in range(210))
    texts = ["", None, "a b", "A B", long, long + " #", " ".join(["x"] * 300), "X" + long, "é€ \x0b\x1cA", *["copy"] * 60]
    rows = [(i, t, "en", ("s", None, "", "t")[i % 4], 1, "x", 1) for i, t in enumerate(texts * 2)]
    return rows + [(None, "copy", "en", "s", 1, "x", 1), (5, "copy", "en", "s", 1, "x", 1), (5, "copy", "en", "u", 1, "x", 1), (None, None, None, None, None, None, None)]


@pytest.mark.parametrize("fingerprint", [F.xxhash64, lambda t: F.length(t) % 2, lambda t: F.lit(7).cast("long")])
def test_audit_equals_plain_code(spark, fingerprint):
    rows = audit_rows()
    labels = [(0, 1, 0), (3, 1, 1), (3, 0, 0), (9, 0, 1), (12, None, None), (None, 1, 1), (70, 1, 0)]
    got = audit.audited(spark.createDataFrame(rows, SCHEMA).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), fingerprint=lambda t: fingerprint(t).cast("long"))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    got = [tuple(r) for r in got.collect()]
    assert len(got) == 4 * 600 and set(got) == plain_audit(rows, labels)


def test_audit_of_an_empty_table(spark):
    assert audit.audited(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
