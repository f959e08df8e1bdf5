"""Features of arcs counted from records of words, against counted strings."""

from __future__ import annotations

import pyarrow as pa

from glossa.operators import arcwords as B
from glossa.operators import corpus as C
from glossa.operators import flat
from glossa.operators import templates as T

TEXTS = [
    "Plain words walked here. One and another ones went: there!",
    ": a:b c a b:c :NOUN:NOUN: x:NOUN:y walked z. x y:NOUN:z w : :: a::b",
    "a b a:b:c a a:b c b:c x:VERB y:VERB:z x VERB:y",
    "zwölf Straßen. zwölf\x0bStraßen x",
    "",
    None,
    "one",
]


def test_arc_records_count_strings(spark):
    rows = [(k + 20 * j, text, "en") for j in range(6) for k, text in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    expected = {tuple(r) for r in T.counted(C.silver(docs), T.ARC).collect()}
    got = [tuple(r) for r in B.counted(docs, T.ARC).collect()]
    assert len(got) == len(T.ARC) and set(got) == expected


def test_features_equal_over_colons_are_equal_records():
    layout = B._layout(T.ARC)
    words = pa.array(["a", "b:c", "a:b", "c"], pa.large_string())
    one, two = (B._read(words, *[pa.array([v]).to_numpy() for v in x]) for x in ((0, 1, 73), (2, 3, 73)))
    (p, q, x), (v, w, y) = one[0], two[0]
    assert (p.to_pylist(), q.to_pylist(), x.tolist()) == (v.to_pylist(), w.to_pylist(), y.tolist()) == (["a"], ["b:c"], x.tolist())
    assert sum(not kind for kind, *_ in layout) == sum(not B._words(cols) for _, cols in T.ARC)


def test_shuffled_words_are_records_of_a_slice():
    """A frequent pair is one record of a slice, and equal records have equal parts in every slice."""
    t = flat.annotated(pa.array(["one two three four. " * 500]), pa.array([1]))
    words, a, b, x = B.records(t, B._layout(T.ARC))
    assert len(a) == len({*zip(a.tolist(), b.tolist(), x.tolist(), strict=True)}) < 400
    assert B._unpacked(B._packed(words)).to_pylist() == words.to_pylist() and words[0].as_py() == ""
    assert B._hashed(words).tolist() == [int(B._hashed(words.slice(k, 1))[0]) for k in range(len(words))]
