"""The operators against brute force on small tables: odd rows (nulls, empty texts, ties, repeated rows), and whole sf0.001."""

import hashlib
import random

import numpy as np
import pytest

from glossa.llm import bpe, fingerprint, licenses, mixing, neardup, pii, quality, sharding, substring, warc
from glossa.llm.arrays import grams, words

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string"
ODD = [(1, None, "a"), (2, "", "a"), (3, " \n\t", None), (4, "one two", "b"), (4, "one two", "b"), (None, "x y z", None), (5, "word " * 30000, "c")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_grams():
    h = words([b"a b c d e f a b c d e f"]).hashes
    for n in (1, 2, 3, 5, 6, 12, 13):
        g = grams(h, n)
        assert len(g) == max(0, 13 - n) and (n > 6 or g[0] == g[6])


def test_bpe_is_the_library(spark, odd, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    lib, own = Tokenizer.from_file(path), bpe.WordBpe(open(path, "rb").read())
    lib.no_truncation()
    lib.no_padding()
    rng = random.Random(1)
    texts = ["", "Hello, World's <|endoftext|>x", "İ ΑΣ\x1cb\x85d​e﻿ ﬁǅẞ é 각", "a" * 300] + ["".join(rng.choice("abTH'sréÀ \n\t1!?.-_ΣİßＡ日́ͅ\x1f\U0001f600") for _ in range(rng.randint(0, 30))) for _ in range(500)]
    for t in texts:
        ids = lib.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids and own.encode_packed(t)[1] == lib.decode(ids, skip_special_tokens=False)
    got = {r.doc_id: r for r in bpe.encode_digests(odd, path).collect()}
    assert len(got) == 6 and got[1].n_tokens == 0 and got[5].n_tokens == 30000 and got[1].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert bpe.encode_digests(empty, path).count() == 0
    clash = odd.withColumn("ids", odd["doc_id"])
    assert bpe.encode_documents(clash, path).columns == ["doc_id", "text", "source", "ids", "decoded", "n_tokens"]


def test_pseudonyms(spark, odd, empty):
    text = "a bob.42@mail8.example.com +1 (988) 555-2485 4337166598464399 152.143.123.131 2024-02-29 30/02/2024 123-45-6789 GB82 WEST 1234 5698 7654 32 password=b7db7aa4a5fcc78305 4337166598464398"
    rows = spark.createDataFrame([(1, text), (2, f"again {text}"), (3, None), (4, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pseudonymised(rows).collect()}
    out = got[1].text
    assert got[2].text == f"again {out}" and got[3].text is None and got[4].text == "" and got[1].n_pii == 8
    for value in text.split()[1:5]:
        assert value.count("@") == 0 or value not in out
    assert "4337166598464399" not in out and "4337166598464398" in out and "30/02/2024" in out and "2024-02-29" not in out and "152.143.123.131" not in out
    card = out.split()[5]
    assert len(card) == 16 and sum(int(d) if i % 2 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(card)) % 10 == 0
    assert pii.pseudonymised(odd).count() == len(ODD) and pii.pseudonymised(empty).count() == 0


def test_permutations_are_one_to_one(spark):
    from pyspark.sql import functions as F

    r = spark.range(1000).select(pii.permuted(F.lpad(F.col("id").cast("string"), 3, "0"), "k", "t").alias("a"), pii.permuted_number(F.col("id"), 25, 40, "k", "t").alias("b"))
    assert sorted(x.a for x in r.collect()) == [f"{i:03d}" for i in range(1000)] and sorted(x.b for x in r.collect()) == list(range(1000))


def test_suffix_array_repeats(odd, empty):
    def brute(ws, least):
        best = [0] * len(ws)
        for i in range(len(ws)):
            for j in range(len(ws)):
                k = 0
                while i != j and max(i, j) + k < len(ws) and ws[i + k] == ws[j + k]:
                    k += 1
                best[i] = max(best[i], k)
        best = [b if b >= least else 0 for b in best]
        return max(best, default=0), len({p for i, b in enumerate(best) for p in range(i, i + b)})

    rng = random.Random(3)
    for _ in range(100):
        texts = [" ".join(rng.choice("abcd"[: rng.randint(1, 4)]) for _ in range(rng.randint(0, 40))) for _ in range(5)]
        m = quality.measured(texts, quality.RepeatLimits(least=3))
        for i, t in enumerate(texts):
            ws = t.split()
            assert brute(ws, 3) == (m["longest_repeat"][i], m["n_covered"][i])
            three = [tuple(ws[j : j + 3]) for j in range(len(ws) - 2)]
            assert m["n_repeat_words"][i] == len({p for j, x in enumerate(three) if three.count(x) > 1 for p in range(j, j + 3)})
    assert sorted((r.doc_id or 0, r.n_words, r.kept) for r in quality.judged(odd).collect())[-1] == (5, 30000, False)
    assert quality.judged(empty).count() == 0


def _plain_rarity(rows):
    """Inverse document frequency of each word by counting."""
    found = [set(t.split()) for _, t in rows]
    df = {}
    for ws in found:
        for x in ws:
            df[x] = df.get(x, 0) + 1
    return {x: 1 + np.log(len(rows) / max(n, len(rows) / neardup.RAREST)) for x, n in df.items()}


def _plain_similarity(rows):
    """All texts' shingles and weights without the module's code, and the weighted Jaccard similarity of two."""
    idf = _plain_rarity(rows)
    bags = []
    for _, t in rows:
        ws, bag = t.split(), {}
        for g in [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)] or ([tuple(ws)] if ws else []):
            bag[g] = bag.get(g, 0.0) + float(np.mean([idf[x] for x in g]))
        bags.append(bag)

    def similarity(i, j):
        a, b = bags[i], bags[j]
        if not a and not b:
            return 1.0
        if len(b) < len(a):
            a, b = b, a
        shared = sum(min(v, b[k]) for k, v in a.items() if k in b)
        return shared / (sum(a.values()) + sum(b.values()) - shared)

    return similarity


def _plain_classes(rows, similarity):
    """class of each row by all pairs: the smallest non-null doc_id of its connected part."""
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if root(i) != root(j) and similarity(i, j) >= 0.8:
                parent[root(i)] = root(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(root(i), []).append(d)
    return [min((d for d in ids[root(i)] if d is not None), default=None) for i in range(len(rows))]


def test_neardup_against_all_pairs(spark, odd, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, (r.text or "")) for r in docs.collect()]
    want = dict(zip([d for d, _ in rows], _plain_classes(rows, _plain_similarity(rows)), strict=True))
    assert {r.doc_id: r.class_id for r in neardup.classes(docs).collect()} == want
    got = sorted(((r.doc_id or 0), r.class_id) for r in neardup.classes(odd).collect())
    assert got == [(0, None), (1, 1), (2, 1), (3, 1), (4, 4), (4, 4), (5, 5)]
    assert neardup.classes(empty).count() == 0


def test_neardup_group_of_edited_copies(spark):
    """A third of all rows are copies of one text with edits of every size; chains of links join more than direct ones."""
    rng, words_ = random.Random(8), [f"w{i}" for i in range(400)]
    base, rows = [rng.choice(words_) for _ in range(150)], []
    for i in range(240):
        if i % 3:
            ws = [rng.choice(words_) for _ in range(rng.randint(20, 150))]
        else:
            ws = [w if rng.random() > rng.choice([0, 0.01, 0.03, 0.06]) else rng.choice(words_) for w in base]
        rows.append((i if i % 11 else (None if i % 2 else 7), " ".join(ws)))
    similarity = _plain_similarity(rows)
    want = _plain_classes(rows, similarity)
    got = neardup.labelled(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    assert sorted((str(d), str(c)) for (d, _), c in zip(rows, want, strict=True)) == sorted((str(r.doc_id), str(r.class_id)) for r in got)
    assert max(np.unique([str(c) for c in want], return_counts=True)[1]) > 25


def test_neardup_bands_find_pairs():
    rng = np.random.default_rng(0)
    for p, least in ((0.8, 0.965), (0.85, 0.99), (0.9, 0.998)):
        agree = rng.random((50_000, neardup.SAMPLES)) < p
        found = np.zeros(len(agree), bool)
        for chosen in neardup._BAND_SAMPLES:
            found |= agree[:, chosen].all(1)
        assert found.mean() > least


def test_samples_agree_as_similarity_says():
    rng = random.Random(2)
    base = [f"w{rng.randint(0, 300)}" for _ in range(600)]
    other = [w if rng.random() > 0.03 else "zz" for w in base]
    rows = [(0, " ".join(base)), (1, " ".join(other))]
    similarity = _plain_similarity(rows)(0, 1)
    w = words([t.encode() for _, t in rows])
    idf = _plain_rarity(rows)
    table = {int(words([x.encode()]).hashes[0]): v for x, v in idf.items()}
    rarity = neardup.Rarity(np.zeros(0, np.uint64), np.zeros(0), 1)
    rarity.of = lambda h: np.array([table[int(x)] for x in h], np.float32)
    agreed = []
    for seed in range(60):
        old = neardup._SEEDS
        neardup._SEEDS = np.random.Generator(np.random.PCG64(seed)).integers(1, 2**63, neardup.SAMPLES, dtype=np.uint64)
        found = neardup.samples(*neardup.shingles(w, rarity), 2)
        neardup._SEEDS = old
        agreed.append((found[0] == found[1]).mean())
    assert abs(np.mean(agreed) - similarity) < 0.04


def test_one_row_stays_of_each_class(spark, empty):
    rows = [(1, "a b", "x", 1), (1, "a b", "x", 2), (None, "a b", "y", 3), (2, None, "z", 4), (None, "", None, 5), (None, "q", "w", 6), (None, "q", "w", 7), (3, "word " * 30000, "c", 8), (4, "word " * 30000, "c", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, k1 string, label int")
    got = neardup.distinct_documents(df)
    assert got.columns == df.columns and sorted((r.doc_id or 0, r.text and r.text[:3], r.k1) for r in got.collect()) == [(0, "q", "w"), (1, "a b", "x"), (2, None, "z"), (3, "wor", "c")]
    assert neardup.distinct_documents(empty).count() == 0


def test_lookup_table(odd, empty):
    names = [f"s{i}" for i in range(10)]
    t = sharding.lookup_table(names, 1009)
    assert sorted(set(np.bincount(t))) in ([100, 101], [101], [100])
    less = sharding.lookup_table(names[:-1], 1009)
    assert (t[t < 9] != less[t < 9]).mean() < 0.2
    by_id = {}
    for r in sharding.placed(odd, "doc_id", names, 1009).collect():
        key = "" if r.doc_id is None else str(r.doc_id)
        assert r.slot == int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % 1009 and r.shard == names[t[r.slot]]
        assert by_id.setdefault(r.doc_id, r.shard) == r.shard
    assert sharding.placed(empty, "doc_id", names, 1009).count() == 0


def test_fingerprints_of_neighbours(spark, odd, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), reverse=True)
    got = {r.doc_id: r for r in fingerprint.compared(docs).collect()}
    assert len(got) == len(rows)
    for i, (d, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        e = fingerprint.edited(t, after)
        own, new, other = fingerprint.fingerprints([t, e, after])
        r = got[d]
        assert (r.n_chars, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) == (len(t), own.hex(), new.hex(), fingerprint.likeness(own, new), fingerprint.likeness(own, other))
        assert r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
    assert fingerprint.compared(odd.select("doc_id", "text")).count() == len(ODD) and fingerprint.compared(empty.select("doc_id", "text")).count() == 0
    a, b = fingerprint.fingerprints([rows[0][1], rows[0][1][:50] + "x" + rows[0][1][50:]])
    assert fingerprint.likeness(a, b) > 0.7
    single = fingerprint.compared(spark.createDataFrame([(1, "only", 1)], "doc_id long, text string, part int")).collect()
    assert [(r.doc_id, r.near_next) for r in single] == [(1, 1.0)]


def test_walk_by_plain_steps():
    """The embedding one step at a time: at each step the walk emits a character and a random bit says whether it moves on."""
    bits = np.random.Generator(np.random.PCG64(7)).integers(0, 2, (fingerprint.PERIOD, fingerprint.CLASSES), dtype=np.uint8)
    rng = random.Random(9)
    for n in (0, 1, 2, 50, 3000):
        points = fingerprint.code_points("".join(rng.choice("abcdéß日 😀\n") for _ in range(n)))
        kinds = [int(p) * 2654435761 % 2**32 >> 26 for p in points]
        reached, step = [0], 0
        for k in kinds:
            while not bits[step % fingerprint.PERIOD, k]:
                step += 1
            step += 1
            reached.append(step)
        assert fingerprint.walk(points).tolist() == reached


def _plain_edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i, *row[1:]], row
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
    return row[-1]


def test_edit_distance():
    rng = random.Random(6)
    for _ in range(300):
        a, b = ["".join(rng.choice("ab日") for _ in range(rng.randint(0, 12))) for _ in range(2)]
        assert fingerprint.edit_distance(a, b) == _plain_edit_distance(a, b)


def test_near_classes_by_edit_distance(spark, odd, empty):
    rng, rows = random.Random(12), []
    bases = ["".join(rng.choice("abcdefghij klmnop") for _ in range(rng.randint(200, 400))) for _ in range(12)]
    for i in range(120):
        t = list(rng.choice(bases[:2] if i % 3 == 0 else bases))
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            at = rng.randrange(len(t))
            t[at : at + rng.randint(0, 1)] = rng.choice("xyz") * rng.randint(0, 1)
        rows.append((i, "".join(t)) if rng.random() > 0.1 else (i, "".join(rng.choice("abcdef") for _ in range(300))))
    parent = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            x, y = rows[i][1], rows[j][1]
            if parent[i] != parent[j] and abs(len(x) - len(y)) <= 0.2 * max(len(x), len(y)) and fingerprint.edit_similarity(x, y) >= 0.8:
                old, new = parent[i], parent[j]
                parent = [new if p == old else p for p in parent]
    want = {i: min(j for j, p in enumerate(parent) if p == parent[i]) for i in range(len(rows))}
    got = {r.doc_id: r.class_id for r in fingerprint.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # The embedding is random: an early edit may keep two walks apart. Classes never hold what distances don't join.
    assert all(want[d] == want[c] for d, c in got.items()) and sum(got[d] == c for d, c in want.items()) >= 0.95 * len(want) and len(set(want.values())) < 40
    small = sorted((r.doc_id or 0, r.class_id or 0) for r in fingerprint.near_classes(odd).collect())
    assert small == [(0, 0), (1, 1), (2, 1), (3, 3), (4, 4), (4, 4), (5, 5)] and fingerprint.near_classes(empty).count() == 0


@pytest.mark.parametrize("bits", [1, 20, 48, 64])
@pytest.mark.parametrize("n", [1, 2, 1000])
def test_folded_keys(n, bits):
    keys = np.sort(np.random.default_rng(n + bits).integers(0, 2**bits - 1, n, dtype=np.uint64, endpoint=True))
    data = substring._folded(keys)
    assert (substring._unfolded(data) == keys).all() and len(data) <= 16 + n * (max(bits - n.bit_length(), 0) + 4) / 8


def test_print_bits():
    assert [substring.print_bits(x) for x in (0, 1 << 29, 1 << 35, 1 << 60)] == [36, 37, 43, 52]



def test_substrings_against_brute_force(spark, odd, empty):
    def brute(rows, size):
        first = {}
        for d, t in rows:
            ws = (t or "").encode().split()
            for i in range(len(ws) - size + 1):
                if d is not None:
                    k = tuple(ws[i : i + size])
                    first[k] = min(first.get(k, d), d)
        out = []
        for d, t in rows:
            ws = (t or "").encode().split()
            gone = [False] * len(ws)
            for i in range(len(ws) - size + 1):
                if d is not None and first[tuple(ws[i : i + size])] < d:
                    gone[i : i + size] = [True] * size
            out.append((d, len(ws), sum(gone), hashlib.sha256(b" ".join(w for w, g in zip(ws, gone, strict=True) if not g)).hexdigest()))
        return sorted(out, key=str)

    rng, rows = random.Random(4), []
    base = [[rng.choice("abcdefghij") for _ in range(60)] for _ in range(6)]
    for d in range(80):
        ws = []
        for _ in range(rng.randint(0, 4)):
            at = rng.randint(0, 30)
            ws += rng.choice(base)[at : at + rng.randint(5, 40)] + [str(rng.randint(0, 99))] * rng.randint(0, 2)
        rows.append((rng.choice([d, d, d, 7, None]), " ".join(ws) if rng.random() > 0.05 else None))
    got = lambda df, size: sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.deduplicated(df, size).collect()), key=str)
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 10) == brute(rows, 10)
    assert got(odd, 50) == brute([r[:2] for r in ODD], 50)
    assert substring.deduplicated(empty).count() == 0


def test_warc_round_trip(spark, tmp_path):
    rows = [(i, "u\nv", "x" * 99 if i % 3 else "y" * 200 + str(i % 7)) for i in range(300)] + [(None, None, None), (3, "u", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    files = warc.write(warc.decided(df), f"file://{tmp_path}/w")
    for split in (64, 1000, 1 << 20):
        got = warc.read(files, split).collect()
        assert len(got) == len(rows) and sum(r.record_type == "revisit" for r in got) == 100 - 7
        assert all(r.payload == ("y" * 200 + str(r.page_id % 7)).encode() for r in got if r.record_type == "response" and r.payload_bytes > 100)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_repeated_and_null_ids(spark):
    x, y = "x" * 150, "y" * 150
    rows = [(1, x), (1, y), (2, x), (2, x), (None, x), (None, "z" * 150), (3, y), (3, "x"), (4, "x")]
    got = warc.round_trip(spark.createDataFrame([(i, "u", h) for i, h in rows], "page_id long, url string, html string")).collect()
    first = {x: 1, y: 1}
    want = [(i, len(h), "revisit" if first.get(h, i) != i else "response", first[h] if first.get(h, i) != i else None) for i, h in rows]
    assert sorted(map(str, want)) == sorted(str((r.page_id, r.payload_bytes, r.record_type, r.refers_to)) for r in got)


def test_licences(spark, odd, empty):
    rows = [(1, "Licensed under CC BY-NC 4.0, and GNU General Public License, version 3. All rights RESERVED"), (2, "cc by cc by"), (3, "Released under the MIT License."), (4, "ccé by")]
    got = {r.doc_id: r for r in licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (17, 3, 2, 14, "cc-by,gpl,reserved")
    assert got[1].labels == "cc-by,cc-by-nc,gpl,gpl-3.0,reserved" and (got[2].n_base, got[2].last_word) == (2, 2)
    assert got[3].labels == "mit" and got[3].score == 0.95 and got[4].labels == ""
    assert {(r.doc_id, r.n_words, r.score) for r in licenses.scanned(odd).collect()} >= {(1, 0, 0.0), (4, 2, 0.0)} and licenses.scanned(empty).count() == 0


def _plain_mix(rows):
    """(source, size, turns of the two passes) in order; words taken of each row by a plain queue, and the sources' targets."""
    sizes = {}
    for s, n, _ in rows:
        sizes[s] = sizes.get(s, 0) + n
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    full, budget = set(), 1.5 * sum(sizes.values())
    while len(full) < len(names):
        level = (budget - sum(2 * sizes[s] for s in full)) / sum(weight[s] for s in names if s not in full)
        new = {s for s in names if s not in full and level * weight[s] > 2 * sizes[s]}
        if not new:
            break
        full |= new
    target = {s: 2.0 * sizes[s] if s in full else level * weight[s] for s in names}
    packets = []
    for s in names:
        done = 0
        for copy in (0, 1):
            for turn, i in sorted((turns[copy], i) for i, (t, _, turns) in enumerate(rows) if t == s):
                n = rows[i][1]
                for at in range(0, n, mixing.QUANTUM):
                    done += min(mixing.QUANTUM, n - at)
                    packets.append((done / target[s], turn, i, copy, at, min(mixing.QUANTUM, n - at)))
    left, taken = int(sum(target.values()) + 1e-6), [0] * len(rows)
    for *_, i, _, _, words_ in sorted(packets):
        taken[i] += min(words_, left)
        left -= min(words_, left)
    return taken, target


def test_mixture(spark, odd, empty):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    key = F.xxhash64(F.lit(17), F.col("doc_id"), F.col("text"))
    turns = F.array(*[F.xxhash64(key, F.lit(k)) for k in (0, 1)])
    rows = docs.select("doc_id", "source", "text", turns.alias("turns")).collect()
    want, target = _plain_mix([(r.source, len((r.text or "").encode().split()), r.turns) for r in rows])
    got = {r.doc_id: r for r in mixing.mixed(docs).collect()}
    assert {r.doc_id: n for r, n in zip(rows, want, strict=True)} == {d: r.taken for d, r in got.items()}
    again = mixing.mixed(docs.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in got.values()) == sorted((r.doc_id, r.taken) for r in again)
    for s, t in target.items():
        of = [r for r in got.values() if r.source == s]
        assert np.isclose(of[0].target, t) and abs(sum(r.taken for r in of) - t) <= 2 * mixing.QUANTUM and all(r.taken <= 2 * r.size for r in of)
    small = mixing.mixed(odd)
    assert small.count() == len(ODD) and {(r.doc_id, r.taken) for r in small.collect()} >= {(1, 0), (None, 6)} and mixing.mixed(empty).count() == 0


def test_remix_keeps_rows_of_null_and_repeated_ids(spark, empty):
    from pyspark.sql import functions as F

    rows = [(None, "s", "a b c " * 20, 1), (7, "s", "d e f " * 20, 2), (7, "t", "g h " * 20, 3), (None, "t", None, 4), (8, "u", "", 5)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, row int").withColumn("size", F.lit("kept"))
    mix = sorted((r.doc_id or 0, r.source, r.taken, r.copies) for r in mixing.mixed(docs).collect())
    out = mixing.remixed(docs)
    assert out.columns == docs.columns and sum(c for *_, c in mix) == out.count()
    counts = {}
    for r in out.collect():
        counts[r.row] = counts.get(r.row, 0) + 1
    assert set(counts) <= {1, 2, 3} and all(n <= 4 for n in counts.values()) and len(counts) == 3
    assert mixing.remixed(empty).count() == 0
