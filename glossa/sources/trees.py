"""Bracketed constituency trees as node rows and back, by windows over the brackets of one tree: no UDF, one shuffle by tree.

An opening bracket's match is the next bracket of the same depth, so spans need no stack. Null and blank lines give no
node; a bracket without a label has an empty one; unbalanced brackets fail.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Marks of lemma and features behind a preterminal's tag.
ATTRIBUTES = "##.*$"


def read(spark: SparkSession, path: str) -> DataFrame:
    """path, tree_id, tree of each line."""
    return spark.read.text(path).select(F.input_file_name().alias("path"), F.monotonically_increasing_id().alias("tree_id"), F.col("value").alias("tree"))


def nodes(trees: DataFrame) -> DataFrame:
    """tree_id, node (from 0, in order of opening), depth (1: root), label, start, end (words from 1, both within; end < start
    if the node has no word), word (of preterminals)."""
    whole = Window.partitionBy("tree_id")
    ordered, level = whole.orderBy("p"), Window.partitionBy("tree_id", "depth").orderBy("p")
    opens, bracket = F.col("t") == "(", F.col("t").isin("(", ")")
    t = trees.select("tree_id", F.posexplode(F.regexp_extract_all("tree", F.lit(r"[()]|[^()\s]+"), F.lit(0))).alias("p", "t"))
    sign = F.when(opens, 1).when(F.col("t") == ")", -1).otherwise(0)
    is_word = ~bracket & (F.lag("t").over(ordered) != "(")
    ahead = lambda n: F.lead("t", n).over(ordered)
    text = lambda c: F.when(~F.col(c).isin("(", ")"), F.col(c))
    t = t.select("*", F.sum(sign).over(ordered).alias("sum"), is_word.alias("is_word"), ahead(1).alias("next"), ahead(2).alias("second"))
    t = t.withColumn("words", F.sum(F.when(F.col("is_word"), 1).otherwise(0)).over(ordered))
    wrong = (F.min("sum").over(whole) < 0) | (F.sum(sign).over(whole) != 0)
    t = t.withColumn("sum", F.when(wrong, F.raise_error(F.lit("unbalanced brackets"))).otherwise(F.col("sum"))).where(bracket)
    t = t.withColumn("depth", F.col("sum") + F.when(opens, 0).otherwise(1)).withColumn("end", F.lead("words").over(level)).where(opens)
    word = F.when(~F.col("next").isin("(", ")"), text("second"))
    label = F.coalesce(text("next"), F.lit(""))
    return t.select("tree_id", (F.row_number().over(ordered) - 1).alias("node"), "depth", F.when(word.isNotNull(), F.regexp_replace(label, ATTRIBUTES, "")).otherwise(label).alias("label"), (F.col("words") + 1).alias("start"), "end", word.alias("word"))


def lines(nodes: DataFrame) -> DataFrame:
    """tree_id, tree: each tree in one line, with one space between parts."""
    after = F.lead("depth").over(Window.partitionBy("tree_id").orderBy("node"))
    closing = F.repeat(F.lit(")"), (F.col("depth") + 1 - F.coalesce(after, F.lit(1))).cast("int"))
    part = F.concat(F.lit("("), F.concat_ws(" ", "label", "word"), closing)
    rows = nodes.select("tree_id", F.struct("node", part.alias("part")).alias("x")).groupBy("tree_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return rows.select("tree_id", F.array_join(F.col("x.part"), " ").alias("tree"))


def with_parents(nodes: DataFrame) -> DataFrame:
    """nodes with parent and parent_label (null for the root): the last node before it that is one level up, by one window."""
    up = nodes.select("tree_id", F.col("depth").alias("level"), F.col("node").alias("at"), F.struct(F.col("node").alias("parent"), F.col("label").alias("parent_label")).alias("over"), F.lit(None).cast(nodes.select(F.struct("*")).schema[0].dataType).alias("own"))
    own = nodes.select("tree_id", (F.col("depth") - 1).alias("level"), F.col("node").alias("at"), F.lit(None).cast(up.schema["over"].dataType).alias("over"), F.struct("*").alias("own"))
    before = Window.partitionBy("tree_id", "level").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    found = up.unionByName(own).withColumn("over", F.last("over", ignorenulls=True).over(before)).where("own is not null")
    return found.select("own.*", "over.parent", "over.parent_label")


def productions(nodes: DataFrame) -> DataFrame:
    """label, children (labels in order, joined by blanks), n: how often a node of a label has just these children."""
    rows = with_parents(nodes).where("parent is not null").groupBy("tree_id", "parent").agg(F.first("parent_label").alias("label"), F.array_sort(F.collect_list(F.struct("node", F.col("label").alias("l")))).alias("c"))
    return rows.groupBy("label", F.array_join("c.l", " ").alias("children")).agg(F.count("*").alias("n"))


def counted_productions(trees: DataFrame) -> DataFrame:
    """The same from lines (column tree), whose brackets are matched inside the task: only counts are shuffled."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, LINES):
                yield _productions_of(b.column("tree").slice(a, LINES).cast(pa.large_string()))

    found = trees.select("tree").mapInArrow(each, "label string, children string, n bigint")
    return found.groupBy("label", "children").agg(F.sum("n").alias("n"))


#: Lines whose brackets are matched together.
LINES = 2_000
_KIND = np.ones(256, np.uint8)  # of each byte: 0 blank, 1 of a word, 2 opens, 3 closes
_KIND[list(b" \t\n\x0b\x0c\r")], _KIND[40], _KIND[41] = 0, 2, 3


def _productions_of(lines: pa.Array) -> pa.RecordBatch:
    """label, children, n of the lines: a node's parent is the last node before it that is one level up."""
    lines = pa.concat_arrays([lines.drop_null()])
    ends = np.frombuffer(lines.buffers()[1], np.int64)[lines.offset : lines.offset + len(lines) + 1] if len(lines) else np.zeros(1, np.int64)
    data = np.frombuffer(lines.buffers()[2] or b"", np.uint8)[: ends[-1]]
    kind = _KIND[data]
    fresh = np.append(True, kind[1:] != 1) if len(kind) else np.zeros(0, bool)
    fresh[1:] |= kind[:-1] != 1
    fresh[ends[:-1][np.diff(ends) > 0]] = True
    token = np.flatnonzero((kind > 0) & fresh)
    what = kind[token]
    level = np.cumsum((what == 2).astype(np.int64) - (what == 3))
    if (level < 0).any() or np.append(0, level)[np.searchsorted(token, ends)].any():
        raise ValueError("unbalanced brackets")
    word = token[what == 1]
    stop = np.append(np.flatnonzero(~((kind == 1) & ~fresh)), len(kind))  # where no word goes on
    size = stop[np.searchsorted(stop, word, side="right")] - word
    place = np.append(0, np.cumsum(size))
    text = data[np.arange(place[-1]) + np.repeat(word - place[:-1], size)]
    words = pa.concat_arrays([pa.LargeStringArray.from_buffers(len(word), pa.py_buffer(place.astype(np.int64)), pa.py_buffer(text)), pa.array([""], pa.large_string())]).dictionary_encode()
    number = np.cumsum(what == 1) - 1
    after = np.append(what, [3, 3])
    opens = np.flatnonzero(what == 2)
    named, leaf = after[opens + 1] == 1, (after[opens + 1] == 1) & (after[opens + 2] == 1)
    names = pa.concat_arrays([words.dictionary, pc.replace_substring_regex(words.dictionary, ATTRIBUTES, "")]).cast(pa.string())
    code = words.indices.to_numpy()[np.where(named, number[np.minimum(opens + 1, len(what) - 1)], len(word))] + np.where(leaf, len(words.dictionary), 0)
    depth, many = level[opens], len(token) + 1
    key = depth * many + opens
    order = np.argsort(key)
    below = np.flatnonzero(depth > 1)
    parent = order[np.searchsorted(key[order], key[below] - many) - 1] if len(below) else below
    by = np.argsort(parent, kind="stable")
    some, count = np.unique(parent, return_counts=True)
    children = pc.binary_join(pa.ListArray.from_arrays(np.append(0, np.cumsum(count)).astype(np.int32), names.take(pa.array(code[below[by]]))), " ")
    table = pa.table({"label": names.take(pa.array(code[some])), "children": children})
    table = table.group_by(["label", "children"]).aggregate([([], "count_all")]).combine_chunks()
    return pa.RecordBatch.from_arrays([pa.concat_arrays(table.column(c).chunks) if table.num_rows else pa.array([], t) for c, t in (("label", pa.string()), ("children", pa.string()), ("count_all", pa.int64()))], names=["label", "children", "n"])


#: Between the labels of one collapsed chain.
SEPARATOR = "|"


def _sums_above(nodes: DataFrame, amount: str, own: bool) -> DataFrame:
    """nodes with above: the sum of amount over a node's ancestors (and itself, if own), by one window: what a node adds ends behind its last word."""
    opened = nodes.withColumns({"__pos": F.col("start").cast("long"), "__at": F.col("node").cast("long"), "__d": F.col(amount).cast("long"), "__node": F.lit(True)})
    closed = nodes.where(F.col(amount) != 0).withColumns({"__pos": (F.col("end") + 1).cast("long"), "__at": F.lit(-1).cast("long"), "__d": -F.col(amount).cast("long"), "__node": F.lit(False)})
    upto = F.sum("__d").over(Window.partitionBy("tree_id").orderBy("__pos", "__at", "__node").rowsBetween(Window.unboundedPreceding, 0))
    return opened.unionByName(closed).withColumn("above", (upto if own else upto - F.col("__d")).cast("int")).where("__node").drop("__pos", "__at", "__d", "__node")


def collapsed(nodes: DataFrame, same_label: bool = False, append: bool = True) -> DataFrame:
    """The nodes with each chain of only children as one node, whose labels are joined by | from above (append), or the lowest.

    same_label collapses only nodes with their parent's label. Empty labels are left out. Nodes without words stay.
    """
    w = Window.partitionBy("tree_id").orderBy("node")
    before = lambda c: F.lag(c).over(w)
    joins = (before("depth") == F.col("depth") - 1) & (before("start") == F.col("start")) & (before("end") == F.col("end")) & (F.col("end") >= F.col("start")) & before("word").isNull()
    joins = F.coalesce(joins & (before("label") == F.col("label")) if same_label else joins, F.lit(False))
    t = _sums_above(nodes.withColumn("joins", joins.cast("int")), "joins", True)
    t = t.withColumn("chain", F.sum(1 - F.col("joins")).over(w))
    labels = F.array_sort(F.collect_list(F.when(F.col("label") != "", F.struct("node", "label"))))
    label = F.coalesce(F.get(F.col("x.label"), F.size("x") - 1), F.lit("")) if same_label or not append else F.array_join("x.label", SEPARATOR)
    one = t.groupBy("tree_id", "chain").agg(F.min("depth").alias("depth"), F.min_by("above", "node").alias("above"), labels.alias("x"), F.first("start").alias("start"), F.first("end").alias("end"), F.max("word").alias("word"))
    return one.select("tree_id", (F.col("chain") - 1).cast("int").alias("node"), (F.col("depth") - F.col("above")).alias("depth"), label.alias("label"), "start", "end", "word")


def expanded(nodes: DataFrame) -> DataFrame:
    """The nodes with those whose labels are joined by | as chains again. Nodes without words stay."""
    parts = F.when(F.col("end") >= F.col("start"), F.split("label", "[" + SEPARATOR + "]")).otherwise(F.array("label"))
    t = _sums_above(nodes.withColumn("parts", parts).withColumn("more", F.size("parts") - 1), "more", False)
    each = t.select("tree_id", "node", "depth", "above", "start", "end", "word", "more", F.posexplode("parts").alias("p", "label"))
    number = F.row_number().over(Window.partitionBy("tree_id").orderBy("node", "p")) - 1
    return each.select("tree_id", number.alias("node"), (F.col("depth") + F.col("above") + F.col("p")).alias("depth"), "label", "start", "end", F.when(F.col("p") == F.col("more"), F.col("word")).alias("word"))


def best_labels(scored: DataFrame, null_label: str | None = None) -> DataFrame:
    """tree_id, node, label, score: each node's label of the largest score; of equal ones the first by name.

    With a null label, which has no score of its own, a node whose best score isn't positive gets that one.
    """
    rows = scored if null_label is None else scored.where(F.col("label") != null_label)
    best = rows.groupBy("tree_id", "node").agg(F.min_by("label", F.struct(-F.col("score"), "label")).alias("label"), F.max("score").alias("score"))
    if null_label is None:
        return best
    none = F.col("score").isNull() | (F.col("score") <= 0)
    full = scored.select("tree_id", "node").distinct().join(best, ["tree_id", "node"], "left")
    return full.select("tree_id", "node", F.when(none, F.lit(null_label)).otherwise(F.col("label")).alias("label"), F.when(none, F.lit(0.0)).otherwise(F.col("score")).alias("score"))


def label_counts(gold: DataFrame, predicted: DataFrame, null_label: str | None = None) -> DataFrame:
    """n_gold, n_pred, n_correct over nodes' labels, the null label aside; `corpus.rates` makes precision, recall and F1 of them."""
    real = lambda c: F.coalesce(F.col(c) != F.lit(null_label), F.col(c).isNotNull())
    both = gold.select("tree_id", "node", F.col("label").alias("g")).join(predicted.select("tree_id", "node", F.col("label").alias("p")), ["tree_id", "node"], "full")
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    same = F.coalesce(F.col("g") == F.col("p"), F.lit(False))
    return both.agg(count(real("g")).alias("n_gold"), count(real("p")).alias("n_pred"), count(same & real("g")).alias("n_correct"))
