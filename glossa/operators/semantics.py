"""Predicates and arguments, paths in trees, mentions and entity clusters."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.operators.corpus import SENT, with_heads
from glossa.operators.factors import assigned_roles


def predicate_arguments(tokens: DataFrame) -> DataFrame:
    """doc_id, sent_id, p, a, role: modifiers of verbs, their role being their tag and side."""
    side = F.when(F.col("m.tok_id") < F.col("h.tok_id"), "0").otherwise("1")
    return with_heads(tokens).where("h.tag = 'VERB'").select("m.doc_id", "m.sent_id", F.col("h.tok_id").alias("p"), F.col("m.tok_id").alias("a"), F.col("h.form").alias("predicate"), F.concat(F.lit("A"), side, F.lit("_"), F.col("m.tag")).alias("role"))


def role_pairs(arguments: DataFrame, most: int) -> DataFrame:
    """first, second, n: the pairs of roles that meet at most predicates (a top-k report; of equal counts the first by name)."""
    a, b = [arguments.select(*SENT, "p", F.col("a").alias(f"a_{x}"), F.col("role").alias(x)) for x in ("first", "second")]
    pairs = a.join(b, [*SENT, "p"]).where("a_first < a_second").groupBy("first", "second").agg(F.count("*").alias("n"))
    return pairs.orderBy(F.desc("n"), "first", "second").limit(most)


def deterministic_roles(arguments: DataFrame) -> DataFrame:
    """role, n, deterministic: whether no predicate has the role twice."""
    once = arguments.groupBy(*SENT, "p", "role").agg(F.count("*").alias("k"))
    return once.groupBy("role").agg(F.sum("k").alias("n"), (F.max("k") == 1).alias("deterministic"))


def semantic_graph(scored: DataFrame, senses: DataFrame) -> DataFrame:
    """doc_id, sent_id, p, sense, score: a predicate's best sense, that of the largest sum of its own score and its positive arcs'.

    A predicate whose best sum isn't positive is none; of equal sums the smaller sense stays. Only sums meet, so the
    senses' arcs are not multiplied out.
    """
    arcs = scored.where("score > 0").groupBy(*SENT, "p", "sense").agg(F.sum("score").alias("arcs"))
    every = senses.join(arcs, [*SENT, "p", "sense"], "left").withColumn("total", F.col("sense_score") + F.coalesce("arcs", F.lit(0.0)))
    best = every.groupBy(*SENT, "p").agg(F.min_by("sense", F.struct(-F.col("total"), "sense")).alias("sense"), F.max("total").alias("score"))
    return best.where("score > 0")


def tree_paths(tokens: DataFrame, ancestors: DataFrame) -> DataFrame:
    """doc_id, sent_id, tok_id, lca, path: from each token to the next one: labels upwards, then downwards from the common ancestor.

    lca is the nearest common ancestor, itself included (0: the root).
    """
    up = ancestors.select(*SENT, "tok_id", "anc", "depth").unionByName(tokens.select(*SENT, "tok_id", F.col("tok_id").alias("anc"), F.lit(0).alias("depth")))
    a = up.select(*SENT, "tok_id", "anc", F.col("depth").alias("da"))
    b = up.select(*SENT, (F.col("tok_id") - 1).alias("tok_id"), "anc", F.col("depth").alias("db"))
    common = a.join(b, [*SENT, "tok_id", "anc"]).groupBy(*SENT, "tok_id").agg(F.min_by("anc", F.col("da")).alias("lca"), F.min("da").alias("da"), F.min("db").alias("db"))
    labels = tokens.select(*SENT, F.col("tok_id").alias("anc"), "deprel")
    steps = up.where("anc > 0").join(labels, [*SENT, "anc"])
    rise = steps.join(common.select(*SENT, "tok_id", "da"), [*SENT, "tok_id"]).where("depth < da").select(*SENT, "tok_id", F.col("depth").alias("place"), F.concat("deprel", F.lit("^")).alias("step"))
    fall = steps.withColumn("tok_id", F.col("tok_id") - 1).join(common.select(*SENT, "tok_id", "db"), [*SENT, "tok_id"]).where("depth < db").select(*SENT, "tok_id", (1_000_000 - F.col("depth")).alias("place"), F.concat("deprel", F.lit("!")).alias("step"))
    path = rise.unionByName(fall).groupBy(*SENT, "tok_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "step"))), lambda x: x["step"]), "").alias("path"))
    return common.join(path, [*SENT, "tok_id"], "left").select(*SENT, "tok_id", "lca", F.coalesce("path", F.lit("")).alias("path"))


def descendant_runs(tokens: DataFrame, ancestors: DataFrame, of: Column) -> DataFrame:
    """doc_id, sent_id, tok_id, start, end: the unbroken run of descendants around each token that `of` chooses."""
    chosen = tokens.where(of).select(*SENT, "tok_id")
    below = ancestors.select(*SENT, F.col("anc").alias("tok_id"), F.col("tok_id").alias("k")).join(chosen, [*SENT, "tok_id"])
    every = below.unionByName(chosen.select(*SENT, "tok_id", F.col("tok_id").alias("k")))
    w = Window.partitionBy(*SENT, "tok_id").orderBy("k")
    runs = every.withColumn("island", F.col("k") - F.row_number().over(w)).groupBy(*SENT, "tok_id", "island").agg(F.min("k").alias("start"), F.max("k").alias("end"))
    return runs.where("start <= tok_id and tok_id <= end").select(*SENT, "tok_id", "start", "end")


def biggest_by_head(runs: DataFrame) -> DataFrame:
    """Of spans with one start the longest, and of those with one end again; what several heads claim counts once."""
    one = runs.groupBy(*SENT, "start").agg(F.max("end").alias("end"))
    return one.groupBy(*SENT, "end").agg(F.min("start").alias("start")).select(*SENT, "start", "end")


def mentions(entities: DataFrame, nouns: DataFrame) -> DataFrame:
    """doc_id, sent_id, start, end, kind, ord: entity spans, and noun spans that lie in none, numbered through the document."""
    e = entities.select(*SENT, "start", "end").distinct()
    inside = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in SENT]
    free = nouns.select(*SENT, "start", "end").distinct().alias("a").join(e.alias("b"), [*inside, F.col("b.start") <= F.col("a.start"), F.col("a.end") <= F.col("b.end")], "left_anti")
    both = e.withColumn("kind", F.lit("entity")).unionByName(free.withColumn("kind", F.lit("noun")))
    return both.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("sent_id", "start", "end")))


def number_and_gender(counts: DataFrame) -> DataFrame:
    """counts (male, female, neutral, plural) with number and gender; a gender needs 3 and twice the others, else unknown."""
    m, f, n = F.col("male"), F.col("female"), F.col("neutral")
    sure = lambda x, y, z: (x >= 2 * (y + z)) & (x >= 3)
    gender = F.when(sure(m, f, n), "male").when(sure(f, m, n), "female").when(sure(n, m, f), "neutral").otherwise("unknown")
    return counts.withColumn("number", F.when(m + f + n >= F.col("plural"), "singular").otherwise("plural")).withColumn("gender", gender)


#: One-letter codes of a pronoun's person, number and gender.
PRONOUN_CODES = ({"1": "first", "2": "second", "3": "third", "x": None}, {"s": "singular", "p": "plural", "x": None}, {"m": "male", "f": "female", "n": "neutral", "x": None})


def pronoun_flags(code: Column) -> list[Column]:
    """person, number and gender of a code of three letters; x is undefined, other letters are an error."""
    out = []
    for place, (name, codes) in enumerate(zip(("person", "number", "gender"), PRONOUN_CODES, strict=True), 1):
        c = F.substring(code, place, 1)
        value = F.raise_error(F.concat(F.lit(f"unknown {name} in code "), code)).cast("string")
        for letter, meaning in codes.items():
            value = F.when(c == letter, F.lit(meaning).cast("string")).otherwise(value)
        out.append(value.alias(name))
    return out


def role_graphs(candidates: DataFrame, roles: Sequence[str], once: Sequence[str]) -> DataFrame:
    """doc_id, sent_id, p, sense, value, n_args, free: the best graph of each predicate (`factors.assigned_roles`).

    candidates: doc_id, sent_id, p, senses (array of scores), args (array of arrays: an argument's score by role, in the order of
    roles). once: roles that a predicate gives to one argument only. free: no two arguments want such a role, so none gives way.
    """
    single = [r in once for r in roles]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for senses, args in zip(b.column("senses").to_pylist(), b.column("args").to_pylist(), strict=True):
                scores = np.array(args, float).reshape(len(args), len(roles))
                sense, chosen, value = assigned_roles(senses, scores, single)
                wanted = [int(r.argmax()) for r in scores if r.max() > 0]
                out.append((sense, value, sum(r is not None for r in chosen), all(wanted.count(k) <= 1 for k, one in enumerate(single) if one)))
            sense, value, n, free = zip(*out, strict=True) if out else ((), (), (), ())
            found = [pa.array(sense, pa.int32()), pa.array(value, pa.float64()), pa.array(n, pa.int32()), pa.array(free, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in (*SENT, "p")], *found], names=[*SENT, "p", "sense", "value", "n_args", "free"])

    types = {f.name: f.dataType.simpleString() for f in candidates.schema}
    keys = ", ".join(f"{c} {types[c]}" for c in (*SENT, "p"))
    return candidates.select(*SENT, "p", "senses", "args").mapInArrow(run, f"{keys}, sense int, value double, n_args int, free boolean")
