"""The pipeline's rows against plain stages, and the operators' contract columns against plain code on whole tables."""

import hashlib
import random
import re

import numpy as np
from test_losses import _plain_pseudonym
from test_operators import _plain_classes, _plain_mix, _plain_similarity

from glossa.llm import bpe, quality, sharding

SF = "/root/testdata/sf0.01"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _rows():
    rng, out = random.Random(31), []
    names = [f"word{i}" for i in range(900)]
    bases = [[rng.choice(names) for _ in range(rng.randint(60, 120))] for _ in range(12)]
    for i in range(90):
        ws = list(bases[i % 5] if i % 3 == 0 else rng.choice(bases) if i % 3 == 1 else [rng.choice(names) for _ in range(rng.randint(30, 130))])
        if i % 4 == 0:
            ws[rng.randrange(len(ws))] = rng.choice(["other", "thing"])
        if i % 6 == 0:
            ws.insert(5, rng.choice(["10.1.2.33", "123-45-6789", "29/02/2024", "a.b@mail.example.org"]))
        if i % 17 == 0:
            ws += ws[:40]
        out.append((None if i % 13 == 0 else 7 if i % 29 == 1 else i, " ".join(ws), "en", rng.choice(["s", "t", None]), 1))
    return [*out, *out[:4], (200, None, None, "s", None), (201, "", "en", "t", 0), (202, "x " * 20000, "en", "s", 40000)]


def _plain_kept(text):
    """The quality operator's verdict by comparing all places of a text with each other."""
    ws = WORD.findall(text.encode())
    three = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    counts = {g: three.count(g) for g in set(three)} if len(ws) < 2000 else {g: 2 for g in set(three)}
    repeated = {p for i, g in enumerate(three) if counts[g] > 1 for p in range(i, i + 3)}
    if len(ws) < 50 or 100 * len(repeated) > 50 * len(ws):
        return False
    limits, best = quality.RepeatLimits(), [0] * len(ws)
    for i in range(len(ws)):
        for j in range(len(ws)):
            k = 0
            while i != j and max(i, j) + k < len(ws) and ws[i + k] == ws[j + k]:
                k += 1
            best[i] = max(best[i], k)
    spans = {p for i, b in enumerate(best) if b >= limits.least for p in range(i, i + b)}
    return len(spans) <= limits.covered * len(ws) and max(best) <= limits.longest


def test_pipeline_by_plain_stages(spark):
    import corpus_pipeline
    import public_tokenizers
    from pyspark.sql import functions as F
    from tokenizers import Tokenizer

    docs = spark.createDataFrame(_rows(), "doc_id long, text string, lang string, source string, n_chars long").withColumn("row", F.lit(1)).withColumn("key", F.lit("clash")).repartition(5)
    got = corpus_pipeline.applied(spark, docs, "").collect()
    rows = [(d, t or "", s) for d, t, _, s, _ in _rows() if _plain_kept(t or "")]
    classes, seen = _plain_classes([(d, t) for d, t, _ in rows], _plain_similarity([(d, t) for d, t, _ in rows])), {}
    # Classes without an id are told apart by their texts' links, so take the parts themselves.
    similarity = _plain_similarity([(d, t) for d, t, _ in rows])
    parts = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if parts[i] != parts[j] and similarity(i, j) >= 0.8:
                old, new = parts[i], parts[j]
                parts = [new if p == old else p for p in parts]
    sizes = {}
    for part, (d, t, s), c in zip(parts, rows, classes, strict=True):
        sizes.setdefault(part, []).append((d is None, d or 0, t, s, c))
    # Of equal ids any row may stay: then the texts' hashes decide, which only Spark knows.
    keys = {(r.text or ""): (r.k1, r.k2) for r in docs.select("text", F.xxhash64(F.lit(1), F.coalesce("text", F.lit(""))).alias("k1"), F.xxhash64(F.lit(2), F.coalesce("text", F.lit(""))).alias("k2")).collect()}
    stay = [min(members, key=lambda x: (x[0], x[1], keys[x[2]], str(x[3]))) for members in sizes.values()]
    found = {"10.1.2.33": "ip", "123-45-6789": "ssn", "29/02/2024": "date", "a.b@mail.example.org": "email"}
    made = {v: _plain_pseudonym(v, k, "glossa-demonstration-key") for v, k in found.items()}
    clean = [(None if none else d, " ".join(made.get(w, w) for w in t.split(" ")), s) for none, d, t, s, _ in stay]
    frame = spark.createDataFrame(clean, "doc_id long, text string, source string")
    key = F.xxhash64(F.lit(17), F.col("doc_id"), F.col("text"))
    turns = {(r.doc_id, r.text): r.turns for r in frame.select("doc_id", "text", F.array(F.xxhash64(key, F.lit(0)), F.xxhash64(key, F.lit(1))).alias("turns")).collect()}
    taken, target = _plain_mix([(s, len(t.split()), turns[d, t]) for d, t, s in clean])
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lib.no_truncation()
    lib.no_padding()
    want = {(d, tuple(lib.encode(t, add_special_tokens=False).ids)) for d, t, _ in clean}
    rows_got = [(r.doc_id, tuple(r.ids)) for r in got]
    assert set(rows_got) <= want and abs(sum(len(t.split()) for d, t, _ in clean) * 1.5 - sum(taken)) <= 1
    # A row for each copy of which the mix takes at least half: a document taken whole twice stands twice.
    for (d, t, _), n in zip(clean, taken, strict=True):
        size, copies = len(t.split()), rows_got.count((d, tuple(lib.encode(t, add_special_tokens=False).ids)))
        assert copies in ({2} if n == 2 * size else {1, 2} if n >= 1.5 * size else {0, 1} if n < 1.0 * size else {1}), (n, size, copies)
    assert corpus_pipeline.applied(spark, docs.limit(0), "").count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near-duplicates", "pseudonyms", "mixture", "tokens"]


def test_bpe_of_all_texts_is_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    lib.no_truncation()
    lib.no_padding()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in bpe.encode_digests(docs, path).collect():
        ids = lib.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_quality_base_columns_by_plain_code(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for r in quality.judged(docs.select("doc_id", "text")).collect():
        t = r.text or ""
        ws = [w.decode() for w in WORD.findall(t.encode())]
        lines = [x for x in t.split("\n") if WORD.search(x.encode())]
        seen = {}
        for i in range(len(ws) - 2):
            seen.setdefault(tuple(ws[i : i + 3]), []).append(i)
        repeated = len({p for at in seen.values() if len(at) > 1 for i in at for p in range(i, i + 3)})
        want = (len(ws), sum(map(len, ws)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), repeated, len(ws) < 50 or 100 * repeated > 50 * len(ws))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want and not (r.base_failed and r.kept)


def test_lookup_table_by_plain_turns():
    """Every shard's whole permutation first, then one free slot a turn."""
    for names, size in (([f"n{i}" for i in range(7)], 101), (["only"], 5), ([f"s{i}" for i in range(13)], 13)):
        number = lambda text: int(hashlib.md5(text.encode()).hexdigest()[:15], 16)
        prefer = {s: [(number(f"offset {s}") % size + k * (number(f"skip {s}") % (size - 1) + 1)) % size for k in range(size)] for s in names}
        assert all(sorted(p) == list(range(size)) for p in prefer.values())
        owner = {}
        while len(owner) < size:
            for s in sorted(names):
                if len(owner) < size:
                    owner[next(x for x in prefer[s] if x not in owner)] = names.index(s)
        assert sharding.lookup_table(names, size).tolist() == [owner[i] for i in range(size)]


def test_broken_operator_is_an_error(tmp_path):
    """The entry points hide a missing subpackage only."""
    import shutil
    import subprocess
    import sys

    import corpus_pipeline

    root = corpus_pipeline.__file__.rpartition("/")[0]
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        shutil.copy(f"{root}/{name}", tmp_path)
    shutil.copytree(f"{root}/glossa", tmp_path / "glossa", ignore=shutil.ignore_patterns("__pycache__"))
    run = lambda: subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(sum(q.startswith('op') for q in e.queries()))"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": ":".join(p for p in sys.path if "site-packages" in p)})
    assert run().stdout.strip() == "10"
    (tmp_path / "glossa/llm/bpe.py").write_text("import nothing_of_this_name\n")
    assert run().returncode != 0
    shutil.rmtree(tmp_path / "glossa/llm")
    (tmp_path / "corpus_pipeline.py").unlink()
    assert run().stdout.strip() == "0"


