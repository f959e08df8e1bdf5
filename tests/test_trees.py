import random

import pytest

from glossa.sources import trees


def test_nodes_and_lines(spark, tmp_path):
    a = "(S (NP (DT the) (NN dog)) (VP (V runs)))"
    (tmp_path / "t.txt").write_text(f"{a}\n\n( (X (N##lem=a|sg## a)))\n()\n")
    read = trees.read(spark, str(tmp_path / "t.txt"))
    found = trees.nodes(read).cache()
    rows = [[tuple(r)[1:] for r in found.where(f"tree_id = {i}").orderBy("node").collect()] for i in range(4)]
    assert rows[0] == [(0, 1, "S", 1, 3, None), (1, 2, "NP", 1, 2, None), (2, 3, "DT", 1, 1, "the"), (3, 3, "NN", 2, 2, "dog"), (4, 2, "VP", 3, 3, None), (5, 3, "V", 3, 3, "runs")]
    assert rows[1] == [] and rows[2] == [(0, 1, "", 1, 1, None), (1, 2, "X", 1, 1, None), (2, 3, "N", 1, 1, "a")] and rows[3] == [(0, 1, "", 1, 0, None)]
    assert {r.tree_id: r.tree for r in trees.lines(found).collect()} == {0: a, 2: "( (X (N a)))", 3: "()"}


@pytest.mark.parametrize("bad", ["(S (A b)", "(S))", ")("])
def test_unbalanced(spark, bad):
    with pytest.raises(Exception, match="unbalanced"):
        trees.nodes(spark.createDataFrame([(1, bad)], "tree_id long, tree string")).collect()


def test_null(spark):
    assert trees.nodes(spark.createDataFrame([(1, None), (2, " ")], "tree_id long, tree string")).count() == 0


def _spines(t, join=True):
    """A nested (label, children or word) with single chains joined, by plain recursion."""
    label, below = t
    if isinstance(below, str):
        return t
    below = [_spines(x) for x in below]
    if len(below) == 1:
        return ("|".join(x for x in (label, below[0][0]) if x), below[0][1])
    return label, below


def _line(t):
    label, below = t
    return f"({label} {below})" if isinstance(below, str) else f"({label} {' '.join(map(_line, below))})"


def _grown(rng, depth=0):
    label = rng.choice("ABC")
    if depth > 4 or rng.random() < 0.25:
        return label, rng.choice(["x", "y"])
    return label, [_grown(rng, depth + 1) for _ in range(rng.choice([1, 1, 2, 3]))]


def test_spines(spark):
    grown = [_grown(random.Random(i)) for i in range(40)]
    nodes = trees.nodes(spark.createDataFrame([(i, _line(t)) for i, t in enumerate(grown)] + [(99, "()"), (100, None)], "tree_id long, tree string"))
    joined = trees.collapsed(nodes).cache()
    got = {r.tree_id: r.tree for r in trees.lines(joined).collect()}
    assert got.pop(99) == "()" and got == {i: _line(_spines(t)) for i, t in enumerate(grown)}
    back = {r.tree_id: r.tree for r in trees.lines(trees.expanded(joined)).collect()}
    assert back.pop(99) == "()" and back == {i: _line(t) for i, t in enumerate(grown)}


def test_spines_of_one_label(spark):
    nodes = trees.nodes(spark.createDataFrame([(1, "(A (A (B (B x))) (C y))"), (2, "( (S (A x) (B y)))")], "tree_id long, tree string"))
    lines = lambda df: {r.tree_id: r.tree for r in trees.lines(df).collect()}
    assert lines(trees.collapsed(nodes, same_label=True))[1] == "(A (A (B x)) (C y))"
    assert lines(trees.collapsed(nodes, append=False)) == {1: "(A (B x) (C y))", 2: "(S (A x) (B y))"}


def test_node_labels(spark):
    scored = spark.createDataFrame([(1, 0, "A", 1.0), (1, 0, "B", 1.0), (1, 1, "A", -1.0), (1, 1, "-", 9.0), (1, 2, "B", 2.0), (1, 3, "-", 0.0)], "tree_id long, node int, label string, score double")
    got = lambda df: [tuple(r) for r in df.orderBy("node").collect()]
    assert got(trees.best_labels(scored)) == [(1, 0, "A", 1.0), (1, 1, "-", 9.0), (1, 2, "B", 2.0), (1, 3, "-", 0.0)]
    best = trees.best_labels(scored, "-")
    assert got(best) == [(1, 0, "A", 1.0), (1, 1, "-", 0.0), (1, 2, "B", 2.0), (1, 3, "-", 0.0)]
    gold = spark.createDataFrame([(1, 0, "A"), (1, 1, "A"), (1, 2, "-"), (1, 3, "-")], "tree_id long, node int, label string")
    assert tuple(trees.label_counts(gold, best, "-").first()) == (2, 2, 1)
    assert tuple(trees.label_counts(gold.limit(0), best.limit(0)).first()) == (0, 0, 0)


def test_parents_and_productions(spark):
    lines = [(1, "(S (NP (DT a) (NN b)) (VP (V c) (NP (NN d))))"), (2, "(S (NP (DT x) (NN y)) (VP (V z)))"), (3, None), (4, "(X w)")]
    found = trees.nodes(spark.createDataFrame(lines, "tree_id long, tree string"))
    up = {(r.tree_id, r.node): (r.parent, r.parent_label) for r in trees.with_parents(found).collect()}
    assert up[1, 0] == (None, None) and up[1, 3] == (1, "NP") and up[1, 6] == (4, "VP") and up[1, 7] == (6, "NP") and up[4, 0] == (None, None) and len(up) == found.count()
    got = {(r.label, r.children): r.n for r in trees.productions(found).collect()}
    assert got == {("S", "NP VP"): 2, ("NP", "DT NN"): 2, ("VP", "V NP"): 1, ("VP", "V"): 1, ("NP", "NN"): 1}
