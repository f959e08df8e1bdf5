"""Lexicons, settings, model strings and the annotator from raw text to clusters."""

import pytest

from glossa.functions import text as X
from glossa.operators import corpus as C
from glossa.operators import learn as L
from glossa.operators import packed as A
from glossa.operators import treelearn as TL
from glossa.operators import parts as P
from glossa.pipeline import Annotator
from glossa.sources import lexicons


def _file(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_lexicons(spark, tmp_path):
    g = lexicons.read_gazetteer(spark, _file(tmp_path, "g", "LOC New York\nLOC York\n\nPER Ana\r\n"))
    assert {r.word: r.tags for r in C.gazetteer_tags(g).collect()} == {"New": ["B-LOC"], "York": ["L-LOC", "U-LOC"], "Ana": ["U-PER"]}
    p = lexicons.read_phrase_files(spark, [_file(tmp_path, "CITY.txt", "San Juan\n")])
    assert [(r.type, r.words) for r in p.collect()] == [("CITY", ["San", "Juan"])]
    assert [tuple(r) for r in lexicons.read_lemmas(spark, _file(tmp_path, "l", "runs\tV\trun\nruns\tV\trunn\n")).collect()] == [("runs", "V", "run")]
    with pytest.raises(Exception, match="too few fields"):
        lexicons.read_lemmas(spark, _file(tmp_path, "bad", "runs\tV\n")).collect()
    assert [tuple(r) for r in lexicons.read_pronouns(spark, _file(tmp_path, "p", "she\t3sf\nyou\t2xx\n")).orderBy("form").collect()] == [("she", "third", "singular", "female"), ("you", "second", None, None)]
    with pytest.raises(Exception, match="unknown person"):
        lexicons.read_pronouns(spark, _file(tmp_path, "q", "it\t9sn\n")).collect()
    assert [r.tags for r in lexicons.read_mention_tags(spark, _file(tmp_path, "m", "noun\tNN\tNNS\n")).collect()] == [["NN", "NNS"]]
    assert sorted(r.tag for r in lexicons.read_tags(spark, _file(tmp_path, "t", "A\nB\nA\n")).collect()) == ["A", "B"]
    counts = lexicons.read_gender_counts(spark, _file(tmp_path, "c", "ana\t0 9 1 0\nthe ana\t8 0 0 0\ncats\t0 0 1 5\n"))
    ments = spark.createDataFrame([(1, ["the", "ana"], "ana"), (2, ["my", "ana"], "ana"), (3, ["cats"], "cats"), (4, ["x"], "x")], "i int, words array<string>, head_word string")
    got = {r.i: (r.number, r.gender) for r in lexicons.phrase_counts(ments, counts).collect()}
    assert got == {1: ("singular", "male"), 2: ("singular", "female"), 3: ("plural", "unknown"), 4: ("singular", "unknown")}


def test_settings_and_models():
    assert lexicons.settings('# c\nlanguage="en"\ntagger = "a b"\n\n\nlanguage="pt"\n') == {"en": {"tagger": "a b"}, "pt": {}}
    for bad in ('tagger="x"', 'language="a"\n\nlanguage="a"', "language=a"):
        with pytest.raises(ValueError):
            lexicons.settings(bad)
    assert P.model_parts("standard") == ["arcs", "consecutive siblings", "grandparents"] and len(P.model_parts("full")) == 7
    for bad in ("cs+gp", "af+zz"):
        with pytest.raises(ValueError):
            P.model_parts(bad)


def test_annotator(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40)
    gold = C.silver(docs)
    rows = C.silver_rows(docs)
    model = TL.trained(rows, A.limits_of(rows), learners=2)
    a = Annotator({"tag": L.association_weights(L.feature_rows(gold)), "parse": model}, tokenizer="whitespace")
    tokens = a.tokenize(a.split_sentences(docs))
    tagged = a.tag(tokens).cache()
    assert tagged.count() == gold.count()
    right = tagged.join(gold.select("doc_id", "sent_id", "tok_id", "tag"), ["doc_id", "sent_id", "tok_id", "tag"]).count()
    assert right > 0.5 * gold.count()
    parsed = a.parse(tagged, C.distance_limits(gold)).cache()
    assert parsed.where("head is null").count() == 0 and C.ancestors(parsed).where("anc = 0").count() == parsed.count()
    found = a.resolve_coreferences(parsed, ["PROP"])
    assert found.count() == found.where("entity <= ord").count() > 0 and a.parse_semantic_dependencies(parsed).count() > 0
    by_score = a.parse(tagged, C.distance_limits(gold), C.silver_scores(C.pruned_arcs(gold, C.distance_limits(gold))))
    heads = lambda found: found.join(gold.select("doc_id", "sent_id", "tok_id", "head"), ["doc_id", "sent_id", "tok_id", "head"]).count()
    assert min(heads(by_score), heads(parsed)) > 0.4 * gold.count()
    with pytest.raises(ValueError):
        Annotator().tag(tokens)
    with pytest.raises(ValueError):
        Annotator().parse(tagged, C.distance_limits(gold))


def test_offsets(spark):
    text = "Ana's cat, née  2x!\nok"
    rows = X.offset_tokens(spark.createDataFrame([(1, "en", 0, text)], "doc_id long, lang string, sent_id int, sentence string")).orderBy("tok_id").collect()
    assert [r.token for r in rows] == ["Ana", "'", "s", "cat", ",", "née", "2x", "!", "ok"] and all(text[r.start : r.end] == r.token for r in rows)


def test_brackets_nest_and_cross(spark):
    tokens = spark.createDataFrame([(1, 0, i) for i in range(1, 8)], "doc_id long, sent_id int, tok_id int")
    spans = [(1, 7, "a"), (2, 4, "b"), (3, 5, "c"), (4, 4, "d"), (5, 6, "b"), (2, 3, "a")]
    frame = spark.createDataFrame([(1, 0, s, e, n) for s, e, n in spans], "doc_id long, sent_id int, start int, end int, name string")
    got = C.bracket_spans(C.bracket_bits(tokens, frame)).collect()
    assert sorted((r.start, r.end, r.name) for r in got) == sorted(spans)


def test_role_and_coreference_readers(spark, tmp_path):
    from glossa.sources import conll

    sdp = _file(tmp_path, "s.sdp", "#1001\n1\tAna\tAna\tNP\t2\tSb\t-\t-\t_\tA0\n2\treads\tread\tVB\t9\tPred\t+\t+\tread.01\t_\n")
    tokens, args = conll.read_roles(spark, sdp, "sdp")
    assert [(r.name, r.form, r.head, r.top, r.predicate) for r in tokens.orderBy("tok_id").collect()] == [("1001", "Ana", 2, False, None), ("1001", "reads", 0, True, "read.01")]
    assert [(r.p, r.a, r.role) for r in args.collect()] == [(2, 1, "A0")]
    old = _file(tmp_path, "o", "1\t_\t_\t_\t_\tAna\tAna\tNP\t2\tSb\t_\tA0\n2\t_\t_\t_\t_\treads\tread\tVB\t0\tPred\tread.01\t_\n")
    assert [(r.p, r.a, r.role) for r in conll.read_roles(spark, old, "conll2008")[1].collect()] == [(2, 1, "A0")]
    text = "#begin document (demo); part 000\ndemo 0 0 Ana NP (S(NP*) 2 Sb _ _ _ A (PER) (0)\ndemo 0 1 reads VB (VP*)) 0 Pred _ _ _ A * -\n\ndemo 0 0 She PR * 0 Sb _ _ _ A * (0)\n\n#end document\n"
    rows = conll.read_coreference(spark, _file(tmp_path, "c", text + text.replace("demo", "two").replace("000", "001"))).orderBy("doc", "sent_id", "tok_id").collect()
    assert [(r.doc, r.part, r.sent_id, r.tok_id, r.form, r.head, r.entity, r.bit) for r in rows][:3] == [("demo", 0, 0, 1, "Ana", 2, "(PER)", "(0)"), ("demo", 0, 0, 2, "reads", 0, "*", "-"), ("demo", 0, 1, 1, "She", 0, "*", "(0)")] and len(rows) == 6


def test_strict_columns(spark, tmp_path):
    from glossa.sources import conll

    ok = _file(tmp_path, "ok", "a\tX\r\nb\tY\r\n \t\r\nc\tZ\r\n")
    assert [(r.form, r.tag, r.tok_id) for r in conll.read(spark, ok, "tagging").orderBy("sent_id", "tok_id").collect()] == [("a", "X", 1), ("b", "Y", 2), ("c", "Z", 1)]
    with pytest.raises(Exception, match="not two fields"):
        conll.read(spark, _file(tmp_path, "three", "a\tb\tc\n"), "tagging").collect()
    with pytest.raises(Exception, match="run from 1"):
        conll.read(spark, _file(tmp_path, "ids", "2\ta\ta\tN\tN\t_\t0\tR\t_\t_\n"), "conllx").collect()


def test_projective_marginals():
    import itertools

    import numpy as np

    from glossa.operators.decode import projective_marginals

    rng = np.random.default_rng(4)
    for n in (2, 3, 5):
        s = rng.normal(size=(n, n))
        trees = []
        for hs in itertools.product(range(n), repeat=n - 1):
            heads = [-1, *hs]
            ok = all(heads[m] != m for m in range(1, n))
            for m in range(1, n):
                v, k = m, 0
                while ok and v and k < n:
                    v, k = heads[v], k + 1
                ok = ok and v == 0
            spans = [(min(h, m), max(h, m)) for m, h in enumerate(heads) if m]
            if ok and not any(a < c < b < d for a, b in spans for c, d in spans):
                trees.append((heads, sum(s[h, m] for m, h in enumerate(heads) if m)))
        z = np.logaddexp.reduce([v for _, v in trees])
        p = np.zeros((n, n))
        for heads, v in trees:
            for m in range(1, n):
                p[heads[m], m] += np.exp(v - z)
        got, logz, entropy = projective_marginals(s)
        assert np.allclose(got, p) and np.isclose(logz, z) and np.isclose(entropy, -sum(np.exp(v - z) * (v - z) for _, v in trees))
