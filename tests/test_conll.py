import pytest

from glossa.operators.corpus import spans
from glossa.sources import conll


def test_round_trip(spark, tmp_path):
    text = "# a\n1\tAna\tAna\tN\tNP\tGender=f|Number=sg\t2\tSb\t_\t_\n2-3\tx\t_\t_\t_\t_\t_\t_\t_\t_\n2\treads\tread\tV\tVB\t_\t0\tPred\t_\t_\n\n\n1\tNo\tno\tX\tX\t_\t0\tPred\t_\t_"
    (tmp_path / "a.conll").write_text(text)
    t = conll.read(spark, str(tmp_path / "a.conll"), "conllx").cache()
    assert [(r.tok_id, r.form, r.feats, r.head) for r in t.orderBy("sent_id", "tok_id").collect()] == [(1, "Ana", ["Gender=f", "Number=sg"], 2), (2, "reads", [], 0), (1, "No", [], 0)]
    conll.write(t, str(tmp_path / "out"), "conllx")
    again = conll.read(spark, str(tmp_path / "out"), "conllx")
    key = lambda d: sorted((r.tok_id, r.form, tuple(r.feats), r.head, r.deprel) for r in d.collect())
    assert key(again) == key(t)


def test_bad_head(spark, tmp_path):
    (tmp_path / "b.conll").write_text("1\ta\ta\tN\tN\t_\t7\tSb\t_\t_\n")
    with pytest.raises(Exception, match="head"):
        conll.read(spark, str(tmp_path / "b.conll"), "conllx").collect()


def test_span_repair(spark):
    rows = [(0, i + 1, t) for i, t in enumerate(["O", "I-X", "I-X", "B-X", "I-Y", "L-Y", "U-X"])]
    t = spark.createDataFrame([(0, s, k, tag) for s, k, tag in rows], "doc_id long, sent_id int, tok_id int, tag string")
    assert sorted((r.start, r.end, r.type) for r in spans(t, "tag").collect()) == [(2, 3, "X"), (4, 4, "X"), (5, 6, "Y"), (7, 7, "X")]
