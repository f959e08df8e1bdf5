"""Parts of higher order over tags, arcs and labels, as joins and windows on the part tables of `corpus`."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossa.operators.corpus import SENT, START, STOP, in_order, with_heads

#: Names of model strings and the kinds of parts that they are short for.
MODEL_ALIASES = {"basic": "af", "standard": "af+cs+gp", "full": "af+cs+gp+as+hb+gs+ts"}
MODEL_PARTS = {"af": "arcs", "cs": "consecutive siblings", "gp": "grandparents", "as": "siblings", "np": "nonprojective arcs", "dp": "directed paths", "hb": "head bigrams", "gs": "grand-siblings", "ts": "tri-siblings"}


def model_parts(model: str) -> list[str]:
    """Kinds of parts of a model string such as af+cs or standard; arcs are a must."""
    names = [p for p in MODEL_ALIASES.get(model, model).split("+") if p]
    if unknown := [p for p in names if p not in MODEL_PARTS]:
        raise ValueError(f"unknown part {unknown[0]} in model {model}")
    if "af" not in names:
        raise ValueError(f"model {model} lacks af: arcs are needed by all others")
    return [MODEL_PARTS[p] for p in names]


def with_boundaries(unigrams: DataFrame) -> DataFrame:
    """Unigram parts with a start mark at place 0 and a stop mark after the last token of each sentence."""
    ends = unigrams.groupBy(*SENT).agg(F.max("tok_id").alias("n"))
    marks = F.explode(F.array(F.struct(F.lit(0).alias("tok_id"), F.lit(START).alias("t")), F.struct((F.col("n") + 1).alias("tok_id"), F.lit(STOP).alias("t"))))
    return unigrams.unionByName(ends.select(*SENT, marks.alias("m")).select(*SENT, "m.tok_id", "m.t", F.lit(1).alias("gold")))


def trigram_parts(unigrams: DataFrame) -> DataFrame:
    """Triples of neighbouring unigram parts, boundaries included; none of sentences of one token."""
    every = with_boundaries(unigrams)
    c, b, a = [every.select(*SENT, (F.col("tok_id") + k).alias("tok_id"), F.col("t").alias(f"t{3 - k}"), F.col("gold").alias(f"g{k}")) for k in (0, 1, 2)]
    long = unigrams.groupBy(*SENT).agg(F.max("tok_id").alias("n")).where("n > 1").select(*SENT)
    key = [*SENT, "tok_id"]
    return c.join(b, key).join(a, key).join(long, SENT, "left_semi").select(*key, "t1", "t2", "t3", (F.col("g0") * F.col("g1") * F.col("g2")).alias("gold"))


def consecutive_siblings(arcs: DataFrame, tokens: DataFrame) -> DataFrame:
    """doc_id, sent_id, h, side, m, s, gold: pairs of a head's candidates on one side, m nearer; m = h before the first one.

    s = 0 on the left and n + 1 on the right stand for no further modifier. Gold: both are, and no gold one is between.
    """
    n = tokens.groupBy(*SENT).agg(F.max("tok_id").alias("n"))
    nodes = arcs.where("h <> m").select(*SENT, "h", F.when(F.col("m") < F.col("h"), "L").otherwise("R").alias("side"), "m", "gold")
    heads = nodes.select(*SENT, "h", "side").distinct().join(n, SENT)
    ends = F.explode(F.array(F.col("h"), F.when(F.col("side") == "L", 0).otherwise(F.col("n") + 1).cast("int")))
    nodes = nodes.unionByName(heads.select(*SENT, "h", "side", ends.alias("m"), F.lit(1).alias("gold")))
    nodes = nodes.withColumn("far", F.abs(F.col("m") - F.col("h")))
    place = Window.partitionBy(*SENT, "h", "side").orderBy("far")
    after = F.min(F.when(F.col("gold") == 1, F.col("far"))).over(place.rowsBetween(1, Window.unboundedFollowing))
    nodes = nodes.withColumn("next_gold", after)
    a, b = nodes.alias("a"), nodes.alias("b")
    on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in (*SENT, "h", "side")]
    gold = ((F.col("a.gold") == 1) & (F.col("b.gold") == 1) & (F.col("b.far") == F.col("a.next_gold"))).cast("int")
    return a.join(b, [*on, F.col("a.far") < F.col("b.far")]).select("a.doc_id", "a.sent_id", "a.h", "a.side", F.col("a.m").alias("m"), F.col("b.m").alias("s"), F.coalesce(gold, F.lit(0)).alias("gold"))


def sided(arcs: DataFrame) -> DataFrame:
    """Arcs from tokens with the side of the modifier."""
    return arcs.where("h > 0").withColumn("side", F.when(F.col("m") < F.col("h"), "L").otherwise("R"))


def tri_siblings(arcs: DataFrame) -> DataFrame:
    """doc_id, sent_id, h, m, s, t, gold: three candidates of a head on one side, in the order of the sentence."""
    a, b, c = [sided(arcs).select(*SENT, "h", "side", F.col("m").alias(x), F.col("gold").alias(f"g_{x}")) for x in ("m", "s", "t")]
    key = [*SENT, "h", "side"]
    found = a.join(b, key).where("m < s").join(c, key).where("s < t")
    return found.select(*SENT, "h", "m", "s", "t", (F.col("g_m") * F.col("g_s") * F.col("g_t")).alias("gold"))


def grand_siblings(arcs: DataFrame) -> DataFrame:
    """doc_id, sent_id, g, h, m, s, gold: two candidates of a head on one side, with a candidate head of that head."""
    a, b = [sided(arcs).select(*SENT, "h", "side", F.col("m").alias(x), F.col("gold").alias(f"g_{x}")) for x in ("m", "s")]
    up = arcs.select(*SENT, F.col("h").alias("g"), F.col("m").alias("h"), F.col("gold").alias("g_h"))
    found = a.join(b, [*SENT, "h", "side"]).where("m < s").join(up, [*SENT, "h"]).where("g <> m and g <> s")
    return found.select(*SENT, "g", "h", "m", "s", (F.col("g_m") * F.col("g_s") * F.col("g_h")).alias("gold"))


def projective_repair(arcs: DataFrame, tokens: DataFrame) -> DataFrame:
    """The arcs from each token's left neighbour (the root for the first) that are missing; with them a projective tree exists."""
    needed = tokens.select(*SENT, (F.col("tok_id") - 1).alias("h"), F.col("tok_id").alias("m"), (F.col("head") == F.col("tok_id") - 1).cast("int").alias("gold"))
    return needed.join(arcs, [*SENT, "h", "m"], "left_anti")


def allowed_labels(tokens: DataFrame) -> DataFrame:
    """m_tag, h_tag, label: labels seen between the tags; the root's tag is the start mark."""
    pairs = with_heads(tokens).select(F.col("m.tag").alias("m_tag"), F.col("h.tag").alias("h_tag"), F.col("m.deprel").alias("label"))
    roots = tokens.where("head = 0").select(F.col("tag").alias("m_tag"), F.lit(START).alias("h_tag"), F.col("deprel").alias("label"))
    return pairs.unionByName(roots).distinct()


def labelled_arcs(arcs: DataFrame, tokens: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, sent_id, h, m, label, gold: arcs times the labels that their tags allow; arcs without any are dropped."""
    m = tokens.select(*SENT, F.col("tok_id").alias("m"), F.col("tag").alias("m_tag"), "deprel")
    h = tokens.select(*SENT, F.col("tok_id").alias("h"), F.col("tag").alias("h_tag"))
    full = arcs.join(m, [*SENT, "m"]).join(h, [*SENT, "h"], "left").withColumn("h_tag", F.coalesce("h_tag", F.lit(START)))
    return full.join(labels, ["m_tag", "h_tag"]).select(*SENT, "h", "m", "label", (F.col("gold") * (F.col("label") == F.col("deprel")).cast("int")).alias("gold"))


def sibling_labels(tokens: DataFrame) -> DataFrame:
    """left, right, n: label pairs of neighbouring modifiers of a head, with marks before the first and after the last."""
    w = Window.partitionBy(*SENT, "head").orderBy("tok_id")
    t = tokens.select(F.coalesce(F.lag("deprel").over(w), F.lit(START)).alias("left"), F.col("deprel").alias("right"), F.lead("deprel").over(w).isNull().alias("last"))
    ends = t.where("last").select(F.col("right").alias("left"), F.lit(STOP).alias("right"))
    return t.select("left", "right").unionByName(ends).groupBy("left", "right").agg(F.count("*").alias("n"))


def bigram_legality(tokens: DataFrame, tag: str = "bio") -> DataFrame:
    """left, right, legal, n: neighbouring tags and whether BIO allows them, boundaries included."""
    w = in_order()
    t = tokens.select(F.coalesce(F.lag(tag).over(w), F.lit(START)).alias("left"), F.col(tag).alias("right"), F.lead(tag).over(w).isNull().alias("last"))
    both = t.select("left", "right").unionByName(t.where("last").select(F.col("right").alias("left"), F.lit(STOP).alias("right")))
    kind = lambda c: F.when(F.col(c).contains("-"), F.substring_index(c, "-", -1))
    legal = ~F.col("right").startswith("I-") | ((F.col("left").startswith("B-") | F.col("left").startswith("I-")) & (kind("left") == kind("right")))
    return both.groupBy("left", "right").agg(F.count("*").alias("n")).withColumn("legal", F.coalesce(legal, F.lit(False)))
