"""The silver-annotated token table and operators over it: vocabularies, windows, spans, trees, parts, metrics.

The driver's tables have no linguistic annotation, so tags, heads and labels are rules over the forms (see `silver`);
they stand in for a corpus and are not linguistics.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.functions.text import ascii_lower, sentences, split_tag, whitespace_tokens

SENT = ["doc_id", "sent_id"]
UNKNOWN, START, STOP = "_UNKNOWN_", "_START_", "_STOP_"


def in_order() -> Window:
    return Window.partitionBy(*SENT).orderBy("tok_id")


def silver(docs: DataFrame) -> DataFrame:
    """doc_id, lang, sent_id, n, tok_id, form, tag, head, deprel, pred_tag, pred_head, pred_deprel: rule-made annotation.

    Tokens form groups of four around their second; groups form clauses of four around their first, whose second token
    hangs from the root. Heads lie on both sides; in every fifth group the last token hangs from the first, so its arc is
    not projective. Each tenth token's prediction is off.
    """
    t = whitespace_tokens(sentences(docs))
    i, n, doc = F.col("tok_id"), F.col("n"), F.col("doc_id")
    t = t.withColumn("tag", _silver_tag(F.col("form"), i)).withColumn("head", _silver_head(i, n, doc))
    odd = (doc * 31 + F.col("sent_id") * 7 + i) % 10 == 0
    t = t.withColumn("pred_tag", F.when(odd, F.when(F.col("tag") == "NOUN", "PROP").otherwise("NOUN")).otherwise(F.col("tag")))
    t = t.withColumn("pred_head", F.when(odd & (i > 1), i - 1).otherwise(F.col("head")))
    side = lambda h: F.when(F.col(h) == 0, "ROOT").when(F.col(h) < i, "LEFT").otherwise("RIGHT")
    label = lambda tag_, h: F.concat_ws("_", tag_, side(h))
    return t.withColumns({"deprel": label("tag", "head"), "pred_deprel": label("pred_tag", "pred_head")}).select("doc_id", "lang", "sent_id", "n", "tok_id", "form", "tag", "head", "deprel", "pred_tag", "pred_head", "pred_deprel")


def _silver_tag(f: Column, i: Column) -> Column:
    return (
        F.when(f.rlike("^[^A-Za-z0-9\\x80-\\x{10FFFF}]+\\z"), "PUNC")
        .when(f.rlike("[0-9]"), "NUM")
        .when(f.rlike("^[A-Z]") & (i > 1), "PROP")
        .when(F.length(f) <= 3, "FUNC")
        .when(f.rlike("[dgn]\\z"), "VERB")
        .when(f.rlike("[esr]\\z"), "NOUN")
        .otherwise("WORD")
    )


def _silver_head(i: Column, n: Column, doc: Column) -> Column:
    group, place = F.floor((i - 1) / 4), (i - 1) % 4
    before = F.when(group % 4 == 0, 0).otherwise(group * 4 - 2)
    last = F.when((doc + group) % 5 == 0, i - 3).otherwise(i - 2)
    return F.when(place == 0, F.when(i == n, before).otherwise(i + 1)).when(place == 1, before).when(place == 2, i - 1).otherwise(last).cast("int")


def silver_rows(docs: DataFrame) -> DataFrame:
    """doc_id, lang, sent_id, and arrays form, tag, head: a row for each sentence with what `silver` says of its tokens. No shuffle."""
    parts = F.filter(F.split("sentence", r"[ \t\n\r]+"), lambda t: t != "")
    rows = sentences(docs).select("doc_id", "lang", "sent_id", parts.alias("form")).where(F.size("form") > 0)
    tags = F.transform("form", lambda f, p: _silver_tag(f, p + 1))
    return rows.select("*", tags.alias("tag"), F.transform("form", lambda _, p: _silver_head(p + 1, F.size("form"), F.col("doc_id"))).alias("head"))


def spread_of(df: DataFrame, least: int = 64 << 20) -> DataFrame:
    """df dealt out to all cores if it has less than `least` bytes for each: a small file is often one row group, which one task reads."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < least * cores else df


# --- vocabularies ---------------------------------------------------------------------------------------------------


def dictionary(tokens: DataFrame, cutoff: int = 0, most: int | None = 65_535) -> DataFrame:
    """kind, value, freq of forms, lower-cased forms and tags seen more than cutoff times.

    Where a kind would reach `most` values the cutoff rises; only the histogram of frequencies (not the values) comes to
    the driver, cut off at the frequency that is enough.
    """
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in (("form", F.col("form")), ("lower", ascii_lower(F.col("form"))), ("tag", F.col("tag")))]))
    counts = tokens.select(kinds.alias("e")).groupBy("e.kind", "e.value").agg(F.count("*").alias("freq"))
    counts = counts.where(F.col("freq") > cutoff)
    if most is None:
        return counts
    above = Window.partitionBy("kind").orderBy(F.desc("freq"))
    histogram = counts.groupBy("kind", "freq").agg(F.count("*").alias("n"))
    level = histogram.withColumn("kept", F.sum("n").over(above)).where(F.col("kept") >= most).groupBy("kind").agg(F.max("freq").alias("raised"))
    return counts.join(F.broadcast(level), "kind", "left").where(F.col("raised").isNull() | (F.col("freq") > F.col("raised"))).drop("raised")


def encoded(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """tokens with known: the form where the dictionary has it, else the name of the unknown word."""
    forms = vocabulary.where("kind = 'form'").select(F.col("value").alias("form"), F.lit(True).alias("k"))
    return tokens.join(forms, "form", "left").withColumn("known", F.when(F.col("k"), F.col("form")).otherwise(UNKNOWN)).drop("k")


def allowed_tags(tokens: DataFrame, key: str = "form") -> DataFrame:
    return tokens.groupBy(key).agg(F.array_sort(F.collect_set("tag")).alias("tags"))


def lemma_table(tokens: DataFrame) -> DataFrame:
    """form, tag, lemma, n: the most frequent lemma of each; of equal counts the one that sorts first.

    The lemma of the silver corpus is the lower-cased form without a final s.
    """
    lemma = F.regexp_replace(ascii_lower(F.col("form")), "s$", "")
    counts = tokens.groupBy(ascii_lower(F.col("form")).alias("form"), "tag", lemma.alias("lemma")).agg(F.count("*").alias("n"))
    return counts.groupBy("form", "tag").agg(F.min_by("lemma", F.struct(-F.col("n"), "lemma")).alias("lemma"), F.max("n").alias("n"))


# --- windows --------------------------------------------------------------------------------------------------------


def context(tokens: DataFrame, reach: int = 2) -> DataFrame:
    """tokens with the forms up to `reach` places before and after, padded."""
    w = in_order()
    cols = [F.coalesce(F.lag("form", k).over(w), F.lit(START)).alias(f"prev{k}") for k in range(1, reach + 1)]
    return tokens.select("*", *cols, *[F.coalesce(F.lead("form", k).over(w), F.lit(STOP)).alias(f"next{k}") for k in range(1, reach + 1)])


def modifiers(tokens: DataFrame) -> DataFrame:
    """tokens with the previous and next modifier of the same head (0: none)."""
    w = Window.partitionBy(*SENT, "head").orderBy("tok_id")
    return tokens.select("*", F.coalesce(F.lag("tok_id").over(w), F.lit(0)).alias("prev_sib"), F.coalesce(F.lead("tok_id").over(w), F.lit(0)).alias("next_sib"))


def global_positions(tokens: DataFrame) -> DataFrame:
    """doc_id, sent_id, n, offset: tokens of a sentence and of all sentences before it in the document."""
    n = tokens.groupBy(*SENT).agg(F.count("*").alias("n"))
    w = Window.partitionBy("doc_id").orderBy("sent_id").rowsBetween(Window.unboundedPreceding, -1)
    return n.select("*", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("offset"))


def delta_encoded(tokens: DataFrame, value: str = "tok_id") -> DataFrame:
    """tokens with side and delta: differences of `value` outward from the head on either side."""
    side = F.when(F.col("tok_id") < F.col("head"), "L").otherwise("R")
    w = Window.partitionBy(*SENT, "head", "side").orderBy(F.abs(F.col("tok_id") - F.col("head")))
    return tokens.withColumn("side", side).withColumn("delta", F.col(value) - F.coalesce(F.lag(value).over(w), F.lit(0)))


def delta_decoded(encoded_: DataFrame) -> DataFrame:
    w = Window.partitionBy(*SENT, "head", "side").orderBy(F.abs(F.col("tok_id") - F.col("head"))).rowsBetween(Window.unboundedPreceding, 0)
    return encoded_.withColumn("value", F.sum("delta").over(w))


# --- spans ----------------------------------------------------------------------------------------------------------


def entity_tags(tokens: DataFrame, tag: str = "tag") -> DataFrame:
    """tokens with bio: maximal runs of PROP as entities of type PROP."""
    w = in_order()
    return tokens.withColumn("bio", F.when(F.col(tag) != "PROP", "O").when(F.lag(tag).over(w) == "PROP", "I-PROP").otherwise("B-PROP"))


def spans(tokens: DataFrame, tag: str = "bio", extra: Sequence[str] = ()) -> DataFrame:
    """doc_id, sent_id, start, end, type of IO, BIO or BILOU tags; an inside or last tag without an open span opens one.

    extra: further columns, equal for all tokens of a sentence, to be kept.
    """
    w = in_order()
    mark, kind = split_tag(F.col(tag))
    t = tokens.withColumn("mark", mark).withColumn("type", kind)
    before_mark, before_type = F.lag("mark").over(w), F.lag("type").over(w)
    inside = F.col("mark").isin("I", "L") & before_mark.isin("B", "I") & (before_type == F.col("type"))
    t = t.withColumn("opens", (~F.coalesce(inside, F.lit(False)) & F.col("type").isNotNull()).cast("int"))
    t = t.withColumn("span", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("type is not null")
    return t.groupBy(*SENT, *extra, "span").agg(F.min("tok_id").alias("start"), F.max("tok_id").alias("end"), F.first("type").alias("type")).drop("span")


def retagged(tokens: DataFrame, found: DataFrame, scheme: str = "BILOU") -> DataFrame:
    """tokens with the tags of spans in a scheme: IO, BIO or BILOU."""
    at = found.select(*SENT, "start", "end", "type", F.explode(F.sequence("start", "end")).alias("tok_id"))
    first, last = F.col("tok_id") == F.col("start"), F.col("tok_id") == F.col("end")
    mark = {"IO": F.lit("I"), "BIO": F.when(first, "B").otherwise("I"), "BILOU": F.when(first & last, "U").when(first, "B").when(last, "L").otherwise("I")}[scheme]
    return tokens.join(at.select(*SENT, "tok_id", F.concat_ws("-", mark, "type").alias("new")), [*SENT, "tok_id"], "left").withColumn(scheme.lower(), F.coalesce("new", F.lit("O"))).drop("new")


def allowed_bigrams(tags: list[str]) -> list[tuple[str, str]]:
    """Pairs of neighbouring tags that BIO or BILOU allow, with the start and stop marks."""
    out = []
    for left in [START, *tags]:
        for right in [*tags, STOP]:
            a, _, x = left.partition("-")
            b, _, y = right.partition("-")
            is_open = a in ("B", "I") and any(t.startswith("L-") for t in tags)
            if b in ("I", "L"):
                ok = a in ("B", "I") and x == y
            else:
                ok = not is_open
            if ok:
                out.append((left, right))
    return out


def uncovered(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """Spans of inner that lie in no span of outer."""
    a, b = inner.alias("a"), outer.alias("b")
    return a.join(b, (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.sent_id") == F.col("b.sent_id")) & (F.col("b.start") <= F.col("a.start")) & (F.col("a.end") <= F.col("b.end")), "left_anti")


# --- trees ----------------------------------------------------------------------------------------------------------


def ancestors(tokens: DataFrame, most: int = 64) -> DataFrame:
    """doc_id, sent_id, tok_id, anc, depth (from 1): all ancestors of each token, the root (0) last, nearest first in depth.

    Each sentence's heads are packed in one row and every token walks up them inside it, so tokens are shuffled once,
    however deep the trees are. most bounds a path's length where heads form a cycle.
    """
    rows = tokens.groupBy(*SENT).agg(F.map_from_entries(F.collect_list(F.struct("tok_id", "head"))).alias("up"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, sent, of, up, depth = [], [], [], [], []
            for d, s, heads in zip(b.column("doc_id").to_pylist(), b.column("sent_id").to_pylist(), map(dict, b.column("up").to_pylist()), strict=True):
                for t in heads:
                    at, k = t, 0
                    while at in heads and k < max(most, len(heads)):
                        at, k = heads[at], k + 1
                        doc.append(d), sent.append(s), of.append(t), up.append(at), depth.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((doc, sent, of, up, depth), (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()), strict=True)], names=[*SENT, "tok_id", "anc", "depth"])

    return rows.mapInArrow(each, "doc_id bigint, sent_id int, tok_id int, anc int, depth int")


def nonprojective(tokens: DataFrame, paths: DataFrame) -> DataFrame:
    """doc_id, sent_id, tok_id, head of arcs over a token that doesn't descend from the head."""
    lo, hi = F.least("tok_id", "head"), F.greatest("tok_id", "head")
    between = tokens.select(*SENT, "tok_id", "head", F.explode(F.when(hi - lo > 1, F.sequence(lo + 1, hi - 1)).otherwise(F.array().cast("array<int>"))).alias("k"))
    below = paths.select(*SENT, F.col("tok_id").alias("k"), F.col("anc").alias("head"))
    return between.join(below, [*SENT, "k", "head"], "left_anti").select(*SENT, "tok_id", "head").distinct()


def ancestry(tokens: DataFrame) -> DataFrame:
    """tokens with ancestry: the parent's and grandparent's tag, < for one to the left and > to the right."""
    up = tokens.select(*SENT, F.col("tok_id").alias("head"), F.col("tag").alias("head_tag"), F.col("head").alias("head2"))
    up2 = tokens.select(*SENT, F.col("tok_id").alias("head2"), F.col("tag").alias("head2_tag"))
    arrow = lambda child, parent: F.when(F.col(parent) < F.col(child), "<").otherwise(">")
    out = tokens.join(up, [*SENT, "head"], "left").join(up2, [*SENT, "head2"], "left")
    return out.withColumn("ancestry", F.concat_ws("", F.when(F.col("head_tag").isNotNull(), F.concat(arrow("tok_id", "head"), "head_tag")), F.when(F.col("head2_tag").isNotNull(), F.concat(arrow("head", "head2"), "head2_tag"))))


# --- parts ----------------------------------------------------------------------------------------------------------


def sized(tokens: DataFrame) -> DataFrame:
    """tokens with n, the number of tokens of their sentence."""
    return tokens.withColumn("n", F.count("*").over(Window.partitionBy(*SENT)))


def with_heads(tokens: DataFrame) -> DataFrame:
    """Tokens (m) joined with their heads (h); those under the root have none."""
    return tokens.alias("m").join(tokens.alias("h"), (F.col("m.doc_id") == F.col("h.doc_id")) & (F.col("m.sent_id") == F.col("h.sent_id")) & (F.col("m.head") == F.col("h.tok_id")))


def distance_limits(tokens: DataFrame) -> DataFrame:
    """m_tag, h_tag, side (of the head: L or R), distance: the largest of each pair of tags and side in gold arcs."""
    side = F.when(F.col("h.tok_id") < F.col("m.tok_id"), "L").otherwise("R")
    return with_heads(tokens).groupBy(F.col("m.tag").alias("m_tag"), F.col("h.tag").alias("h_tag"), side.alias("side")).agg(F.max(F.abs(F.col("m.head") - F.col("m.tok_id"))).alias("distance"))


def pruned_arcs(tokens: DataFrame, limits: DataFrame, keep_gold: bool = True) -> DataFrame:
    """doc_id, sent_id, h, m, gold: root arcs, and arcs no longer than the limit of their tags and side; gold ones always, if asked.

    Candidates are made by position within the longest limit and joined by equality, so no sentence is crossed with itself.
    """
    reach = limits.agg(F.max("distance")).first()[0] or 0
    near = F.array(*[F.col("m") + k for k in range(-reach, reach + 1) if k]).cast("array<int>")
    m = tokens.select(*SENT, F.col("tok_id").alias("m"), F.col("tag").alias("m_tag"), "head")
    h = tokens.select(*SENT, F.col("tok_id").alias("h"), F.col("tag").alias("h_tag"))
    arcs = m.withColumn("h", F.explode(near)).join(h, [*SENT, "h"]).withColumn("side", F.when(F.col("h") < F.col("m"), "L").otherwise("R"))
    arcs = arcs.join(limits, ["m_tag", "h_tag", "side"], "left").where((F.abs(F.col("h") - F.col("m")) <= F.col("distance")) | (F.lit(keep_gold) & (F.col("h") == F.col("head"))))
    both = arcs.select(*SENT, "h", "m", "head").unionByName(m.select(*SENT, F.lit(0).alias("h"), "m", "head"))
    return both.select(*SENT, "h", "m", (F.col("h") == F.col("head")).cast("int").alias("gold"))


def arc_candidates(tokens: DataFrame, reach: int | None = None) -> DataFrame:
    """doc_id, sent_id, h, m, gold: every head (0: the root) for every token but itself, within reach (root arcs always)."""
    heads = F.explode(F.filter(F.sequence(F.lit(0), F.col("n").cast("int")), lambda h: h != F.col("tok_id")))
    arcs = tokens.select(*SENT, heads.alias("h"), F.col("tok_id").alias("m"), "head")
    if reach is not None:
        arcs = arcs.where((F.col("h") == 0) | (F.abs(F.col("h") - F.col("m")) <= reach))
    return arcs.select(*SENT, "h", "m", (F.col("h") == F.col("head")).cast("int").alias("gold"))


def _pairs(arcs: DataFrame, on: Column, *cols: Column) -> DataFrame:
    a, b = arcs.alias("a"), arcs.alias("b")
    return a.join(b, (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.sent_id") == F.col("b.sent_id")) & on).select("a.doc_id", "a.sent_id", *cols, (F.col("a.gold") * F.col("b.gold")).alias("gold"))


def sibling_parts(arcs: DataFrame) -> DataFrame:
    return _pairs(arcs, (F.col("a.h") == F.col("b.h")) & (F.col("a.m") < F.col("b.m")), F.col("a.h").alias("h"), F.col("a.m").alias("m"), F.col("b.m").alias("s"))


def grandparent_parts(arcs: DataFrame) -> DataFrame:
    return _pairs(arcs, (F.col("a.m") == F.col("b.h")) & (F.col("a.h") != F.col("b.m")), F.col("a.h").alias("g"), F.col("b.h").alias("h"), F.col("b.m").alias("m"))


def head_bigram_parts(arcs: DataFrame) -> DataFrame:
    return _pairs(arcs, F.col("a.m") + 1 == F.col("b.m"), F.col("b.h").alias("h"), F.col("b.m").alias("m"), F.col("a.h").alias("prev_h"))


def coparent_parts(arcs: DataFrame) -> DataFrame:
    return _pairs(arcs, (F.col("a.m") == F.col("b.m")) & (F.col("a.h") < F.col("b.h")), F.col("a.h").alias("h1"), F.col("b.h").alias("h2"), F.col("a.m").alias("m"))


def unigram_parts(tokens: DataFrame, allowed: DataFrame, every: list[str] | None = None) -> DataFrame:
    """doc_id, sent_id, tok_id, t, gold: each token with the tags that its form has had; a form not seen gets `every` tag."""
    tags = F.coalesce("tags", F.array(*[F.lit(t) for t in every or []]).cast("array<string>"))
    return tokens.join(allowed, "form", "left").select(*SENT, "tok_id", F.explode(tags).alias("t"), "tag").select(*SENT, "tok_id", "t", (F.col("t") == F.col("tag")).cast("int").alias("gold"))


def bigram_parts(unigrams: DataFrame) -> DataFrame:
    """Pairs of neighbouring unigram parts."""
    a, b = unigrams.alias("a"), unigrams.alias("b")
    on = (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.sent_id") == F.col("b.sent_id")) & (F.col("a.tok_id") + 1 == F.col("b.tok_id"))
    return a.join(b, on).select("b.doc_id", "b.sent_id", "b.tok_id", F.col("a.t").alias("t1"), F.col("b.t").alias("t2"), (F.col("a.gold") * F.col("b.gold")).alias("gold"))


# --- scores ---------------------------------------------------------------------------------------------------------


def silver_scores(arcs: DataFrame) -> DataFrame:
    """arcs with a whole-number score that is a rule over positions, exact in any engine."""
    return arcs.withColumn("score", ((F.col("h") * 7 + F.col("m") * 13 + F.col("doc_id") % 11) % 17 + F.col("gold") * 5).cast("double"))


def best_heads(scored: DataFrame) -> DataFrame:
    """The best head of each token; of equal scores the smallest head."""
    return scored.groupBy(*SENT, "m").agg(F.max_by("h", F.struct("score", -F.col("h"))).alias("h"), F.max("score").alias("score"))


def marginals(scored: DataFrame) -> DataFrame:
    """scored with p, the softmax over each token's heads, and logz."""
    w = Window.partitionBy(*SENT, "m")
    top = F.max("score").over(w)
    return scored.withColumn("top", top).withColumn("logz", F.col("top") + F.log(F.sum(F.exp(F.col("score") - F.col("top"))).over(w))).withColumn("p", F.exp(F.col("score") - F.col("logz"))).drop("top")


def top_heads(scored: DataFrame, k: int = 10, ratio: float = 1e-4) -> DataFrame:
    """Up to k heads of each token whose probability is at least ratio times the best; the best always."""
    w = Window.partitionBy(*SENT, "m").orderBy(F.desc("p"), "h")
    best = F.max("p").over(Window.partitionBy(*SENT, "m"))
    return marginals(scored).withColumn("rank", F.row_number().over(w)).withColumn("best", best).where((F.col("rank") <= k) & ((F.col("rank") == 1) | (F.col("p") >= ratio * F.col("best")))).drop("best")


# --- metrics --------------------------------------------------------------------------------------------------------


def chunk_scores(gold: DataFrame, predicted: DataFrame, by: list[str]) -> DataFrame:
    """by, n_gold, n_pred, n_correct, precision, recall, f1 of spans; a measure without cases is 0."""
    key = list(dict.fromkeys([*SENT, "start", "end", "type", *by]))
    both = gold.select(*key, F.lit(1).alias("g")).join(predicted.select(*key, F.lit(1).alias("p")), key, "full")
    sums = both.groupBy(*by).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in (("g", "n_gold"), ("p", "n_pred"))], F.coalesce(F.sum(F.col("g") * F.col("p")), F.lit(0)).alias("n_correct"))
    return rates(sums)


def rates(sums: DataFrame) -> DataFrame:
    p = F.coalesce(F.try_divide("n_correct", "n_pred"), F.lit(0.0))
    r = F.coalesce(F.try_divide("n_correct", "n_gold"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * F.col("n_correct"), F.col("n_gold") + F.col("n_pred")), F.lit(0.0))
    return sums.select("*", p.alias("precision"), r.alias("recall"), f1.alias("f1"))


def label_scores(tokens: DataFrame, gold: str, predicted: str, also: Column | None = None) -> DataFrame:
    """label, n_gold, n_pred, n_correct, precision, recall, f1 of token labels; also: what else a correct one needs."""
    right = (F.col(gold) == F.col(predicted)) & (F.lit(True) if also is None else also)
    sides = F.explode(F.array(F.struct(F.col(gold).alias("label"), F.lit(1).alias("g"), F.lit(0).alias("p"), right.cast("int").alias("c")), F.struct(F.col(predicted).alias("label"), F.lit(0).alias("g"), F.lit(1).alias("p"), F.lit(0).alias("c"))))
    rows = tokens.select(sides.alias("s")).groupBy("s.label").agg(F.sum("s.g").alias("n_gold"), F.sum("s.p").alias("n_pred"), F.sum("s.c").alias("n_correct"))
    return rates(rows)


def errors(tokens: DataFrame, by: list[str]) -> DataFrame:
    """by (form, or before and after: the neighbours' tags), head_errors, label_errors, both_errors, n; where there is an error."""
    w = in_order()
    head, label = F.col("head") != F.col("pred_head"), F.col("deprel") != F.col("pred_deprel")
    t = tokens.withColumns({"before": F.coalesce(F.lag("tag").over(w), F.lit(START)), "after": F.coalesce(F.lead("tag").over(w), F.lit(STOP))}) if "before" in by else tokens
    count = lambda c: F.sum(c.cast("int"))
    return t.groupBy(*by).agg(count(head).alias("head_errors"), count(label).alias("label_errors"), count(head & label).alias("both_errors"), F.count("*").alias("n")).where("head_errors + label_errors > 0")


def folds(ids: DataFrame, n: int) -> DataFrame:
    """doc_id, fold: runs of neighbouring ids of ceil(rows / n) rows, by ranks without a global window.

    Ids are sorted in ranges; a range's rows are ranked inside it and shifted by the rows of the ranges before, of which only
    the counts meet in one task.
    """
    total = ids.count()
    size = max(1, -(-total // n))
    parts = max(1, min(4096, total // 100_000 + 1))
    rows = ids.repartitionByRange(parts, "doc_id").withColumn("part", F.spark_partition_id())
    counts = rows.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy("doc_id")))
    return ranked.join(F.broadcast(before), "part").select("doc_id", F.floor((F.col("before") + F.col("rank") - 1) / size).alias("fold"))


def typed_tags(tokens: DataFrame, tag: str, kinds: list[str]) -> DataFrame:
    """tokens with bio: runs of one of the kinds of tags as entities of that type."""
    w = in_order()
    kind = F.when(F.col(tag).isin(kinds), F.col(tag))
    return tokens.withColumn("bio", F.when(kind.isNull(), "O").when(F.lag(kind).over(w) == kind, F.concat(F.lit("I-"), kind)).otherwise(F.concat(F.lit("B-"), kind)))


def arc_scores(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """n_gold, n_pred, n_correct, n_labelled (also with the right role) of arcs (h, m, role)."""
    key = [*SENT, "h", "m"]
    g, p = gold.select(*key, F.col("role").alias("g")), predicted.select(*key, F.col("role").alias("p"))
    one = lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0))
    both = F.col("g").isNotNull() & F.col("p").isNotNull()
    return g.join(p, key, "full").agg(one(F.col("g").isNotNull()).alias("n_gold"), one(F.col("p").isNotNull()).alias("n_pred"), one(both).alias("n_correct"), one(both & (F.col("g") == F.col("p"))).alias("n_labelled"))


def frame_confusions(tokens: DataFrame) -> DataFrame:
    """gold, pred, n: labels of a head's modifiers in order, as annotated and as predicted, where they differ."""

    def frames(head: str, label: str, name: str) -> DataFrame:
        row = F.array_sort(F.collect_list(F.struct("tok_id", F.col(label).alias("l"))))
        return tokens.where(F.col(head) > 0).groupBy(*SENT, F.col(head).alias("h")).agg(F.array_join(F.transform(row, lambda x: x["l"]), " ").alias(name))

    both = frames("head", "deprel", "gold").join(frames("pred_head", "pred_deprel", "pred"), [*SENT, "h"], "full").where(~F.col("gold").eqNullSafe(F.col("pred")))
    return both.groupBy(F.coalesce("gold", F.lit("")).alias("gold"), F.coalesce("pred", F.lit("")).alias("pred")).agg(F.count("*").alias("n"))


def bigram_ids(tokens: DataFrame) -> DataFrame:
    """t1, t2, id, n: neighbouring tags with their mixed-radix code over the sorted tags."""
    tags = [r.tag for r in tokens.select("tag").distinct().orderBy("tag").collect()]  # a tag set, a few dozen at most
    place = lambda c: F.array_position(F.array(*[F.lit(t) for t in tags]), c) - 1
    pairs = tokens.select(F.lag("tag").over(in_order()).alias("t1"), F.col("tag").alias("t2")).where("t1 is not null").groupBy("t1", "t2").agg(F.count("*").alias("n"))
    return pairs.select("t1", "t2", (place(F.col("t1")) * len(tags) + place(F.col("t2"))).alias("id"), "n")


def bracket_bits(tokens: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, sent_id, tok_id, bit: spans (start, end, name) as (name at their first and name) at their last token, joined by |; - for none."""
    order = F.struct("start", "end", "name")
    alone = F.col("start") == F.col("end")
    first = found.select(*SENT, F.col("start").alias("tok_id"), order.alias("o"), F.when(alone, F.concat(F.lit("("), "name", F.lit(")"))).otherwise(F.concat(F.lit("("), "name")).alias("piece"))
    last = found.where(~alone).select(*SENT, F.col("end").alias("tok_id"), order.alias("o"), F.concat("name", F.lit(")")).alias("piece"))
    bits = first.unionByName(last).groupBy(*SENT, "tok_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "piece"))), lambda x: x["piece"]), "|").alias("bit"))
    return tokens.select(*SENT, "tok_id").join(bits, [*SENT, "tok_id"], "left").withColumn("bit", F.coalesce("bit", F.lit("-")))


def bracket_spans(bits: DataFrame) -> DataFrame:
    """doc_id, sent_id, start, end, name from bracket bits: a closing bracket ends the latest open one of its name.

    Within a name, openings raise and closings lower a running level; an opening and the next closing of its level are a span.
    """
    pieces = bits.where("bit <> '-'").select(*SENT, "tok_id", F.posexplode(F.split("bit", r"\|")).alias("place", "piece"))
    alone = pieces.where(r"piece rlike '^\\(.*\\)$'").select(*SENT, F.col("tok_id").alias("start"), F.col("tok_id").alias("end"), F.regexp_replace("piece", r"[()]", "").alias("name"))
    rest = pieces.where(r"not piece rlike '^\\(.*\\)$'").select(*SENT, "tok_id", "place", F.regexp_replace("piece", r"[()]", "").alias("name"), F.col("piece").startswith("(").alias("opens"))
    # At one token closings come before openings, so that a mention that begins where another of its name ends isn't closed at once.
    w = Window.partitionBy(*SENT, "name").orderBy("tok_id", "opens", "place")
    step = F.when(F.col("opens"), 1).otherwise(-1)
    levels = rest.withColumn("sum", F.sum(step).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("level", F.when(F.col("opens"), F.col("sum")).otherwise(F.col("sum") + 1))
    same = Window.partitionBy(*SENT, "name", "level").orderBy("tok_id", "opens", "place")
    pairs = levels.withColumn("then", F.lead("tok_id").over(same)).withColumn("closed", ~F.lead("opens").over(same)).where("opens and closed")
    return alone.unionByName(pairs.select(*SENT, F.col("tok_id").alias("start"), F.col("then").alias("end"), "name"))


def gazetteer_tags(entries: DataFrame) -> DataFrame:
    """word, tags (sorted): for each word of entries (type, words) the places that it has in entries, as B, I, L or U and the type."""
    n = F.size("words")
    each = entries.select("type", n.alias("n"), F.posexplode("words").alias("p", "word"))
    mark = F.when(F.col("n") == 1, "U").when(F.col("p") == 0, "B").when(F.col("p") == F.col("n") - 1, "L").otherwise("I")
    return each.groupBy("word").agg(F.array_sort(F.collect_set(F.concat_ws("-", mark, "type"))).alias("tags"))
