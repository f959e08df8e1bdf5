"""Feature templates, linear scores, and online learners of sequence taggers over sentence-packed rows.

Learned models are matrices of 2^bits rows: a feature's row is its hash, so a model's size is a parameter and neither tasks
nor the driver hold more when the corpus and its vocabulary grow. Features that share a row share their weights.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.functions.text import flag_bits, prefix, suffix
from glossa.operators.corpus import SENT, context
from glossa.operators.decode import sequence_marginals, viterbi

#: The tagger's unigram templates: name and columns; a null column drops the feature.
TAGGER = [
    ("bias", []),
    ("w", ["form"]),
    ("w-1", ["prev1"]),
    ("w+1", ["next1"]),
    ("w-2", ["prev2"]),
    ("w+2", ["next2"]),
    *[(f"p{n}", [f"prefix{n}"]) for n in range(1, 5)],
    *[(f"s{n}", [f"suffix{n}"]) for n in range(1, 5)],
    ("flags", ["flags"]),
]


#: The flags' tests in their order, as SQL over form; and the bits that stay at a sentence's first word.
FLAG_SQL = (
    "regexp_matches(form, '[0-9]')", "regexp_matches(form, '^[0-9]+$')", "regexp_matches(form, '[A-Z]')", "regexp_matches(form, '^[A-Z]+$')", "regexp_matches(form, '^[A-Z]')",
    "(regexp_matches(form, '[A-Z]') and regexp_matches(form, '[a-z]'))", "contains(form, '-')", "contains(form, '.')", "regexp_matches(form, '^\\p{P}+$')",
)
NO_CAPITALS = 511 - (4 | 8 | 16 | 32)


def with_parts(tokens: DataFrame) -> DataFrame:
    """tokens with the columns that templates name. Flags of capitals don't count at a sentence's first word."""
    t = context(tokens)
    f = F.col("form")
    affixes = [F.when(F.length(f) >= n, part(f, n)).alias(f"{name}{n}") for name, part in (("prefix", prefix), ("suffix", suffix)) for n in range(1, 5)]
    bits = F.when(F.col("tok_id") == 1, flag_bits(f).bitwiseAND(F.lit(NO_CAPITALS))).otherwise(flag_bits(f))
    return t.select("*", *affixes, bits.cast("string").alias("flags"))


def compiled(templates: list[tuple[str, list[str]]]) -> Column:
    """One array of feature strings name:value:value, from one projection; features with a null part are left out."""
    return F.array_compact(F.array(*[F.concat(F.lit(name), *[x for c in cols for x in (F.lit(":"), F.col(c))]) for name, cols in templates]))


def feature_rows(tokens: DataFrame, templates: list[tuple[str, list[str]]] = TAGGER, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, sent_id, tok_id, tag, the columns to keep, feature: one row for each feature of each token."""
    return with_parts(tokens).select(*SENT, "tok_id", "tag", *keep, F.explode(compiled(templates)).alias("feature"))


def count_weights(features: DataFrame) -> DataFrame:
    """feature, label, w: how often a feature had a tag; the simplest supported-feature weights."""
    return features.groupBy("feature", F.col("tag").alias("label")).agg(F.count("*").cast("double").alias("w"))


def association_weights(features: DataFrame) -> DataFrame:
    """feature, label, w: positive pointwise mutual information of features and tags, a model from counts alone."""
    pairs = features.groupBy("feature", F.col("tag").alias("label")).agg(F.count("*").alias("n"))
    of_feature = pairs.groupBy("feature").agg(F.sum("n").alias("nf"))
    of_label = pairs.groupBy("label").agg(F.sum("n").alias("nl"))
    total = of_label.agg(F.sum("nl")).first()[0] or 1
    w = F.log(F.col("n") * F.lit(float(total)) / (F.col("nf") * F.col("nl")))
    return pairs.join(of_feature, "feature").join(F.broadcast(of_label), "label").select("feature", "label", w.alias("w")).where("w > 0")


def scored(features: DataFrame, weights: DataFrame) -> DataFrame:
    """doc_id, sent_id, tok_id, label, score: sums of the weights of a token's features; missing ones count 0."""
    return features.join(weights, "feature").groupBy(*SENT, "tok_id", "label").agg(F.sum("w").alias("score"))


def gradient(features: DataFrame, predicted: str) -> DataFrame:
    """feature, label, gradient: counts with the gold label less counts with the predicted one, where they differ."""
    sides = F.explode(F.array(F.struct(F.col("tag").alias("label"), F.lit(1).alias("d")), F.struct(F.col(predicted).alias("label"), F.lit(-1).alias("d"))))
    return features.where(F.col("tag") != F.col(predicted)).select("feature", sides.alias("s")).groupBy("feature", "s.label").agg(F.sum("s.d").alias("gradient")).where("gradient <> 0")


def best_labels(scores: DataFrame) -> DataFrame:
    """Each token's label of the largest score; of equal ones the first."""
    return scores.groupBy(*SENT, "tok_id").agg(F.min_by("label", F.struct(-F.col("score"), "label")).alias("label"), F.max("score").alias("score"))


#: Logarithm of a model's rows.
BITS = 18
#: What training does with a sentence: the guess (best tags, or marginals), whether wrong tags score higher by their cost, the step.
ALGORITHMS = {
    "perceptron": ("best", False, "one"),
    "svm_mira": ("best", True, "mira"), "crf_mira": ("marginals", False, "mira"), "crf_margin_mira": ("marginals", True, "mira"),
    "svm_sgd": ("best", True, "sgd"), "crf_sgd": ("marginals", False, "sgd"), "crf_margin_sgd": ("marginals", True, "sgd"),
}
#: Steps of gradient descent at time t (from 0) of n sentences an epoch, as parts of the first.
SCHEDULES = {"fixed": lambda t, n: 1.0, "invsqrt": lambda t, n: (t + 1) ** -0.5, "inv": lambda t, n: 1 / (t + 1), "lecun": lambda t, n: 1 / (1 + t / n)}


class SequenceLearner:
    """First-order tagger by online learning.

    perceptron and the mira algorithms average their weights; the sgd ones shrink theirs at each step by decay and give the last.
    """

    def __init__(self, k: int, algorithm: str = "perceptron", bits: int = BITS, c: float = 1.0, rate: float = 0.1, schedule: str = "invsqrt", decay: float = 0.0, sentences: int = 1):
        """k: tags. c: the largest step of mira. rate, schedule, decay and sentences (of an epoch): of gradient descent."""
        if algorithm == "mira":
            raise NotImplementedError("plain mira isn't implemented; svm_mira is its cost-augmented form")
        if algorithm not in ALGORITHMS or schedule not in SCHEDULES:
            raise ValueError(f"unknown algorithm {algorithm} or schedule {schedule}")
        self.k, self.c, self.rate, self.decay, self.sentences = k, c, rate, decay, sentences
        self.guess, self.costs, self.step = ALGORITHMS[algorithm]
        self.schedule = SCHEDULES[schedule]
        self.w, self.sums = np.zeros((1 << bits, k)), np.zeros((1 << bits, k))
        self.pair, self.pair_sum = np.zeros((k, k)), np.zeros((k, k))
        self.scale, self.t = 1.0, 0

    def _pairs(self, tags: np.ndarray) -> np.ndarray:
        """How often tags are neighbours."""
        return np.bincount(tags[:-1] * self.k + tags[1:], minlength=self.k * self.k).reshape(self.k, self.k).astype(np.float64)

    def guessed(self, unary: np.ndarray, pair: np.ndarray, gold: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """The guess for each place and each two neighbours, as shares of tags, and the loss."""
        n, places = len(gold), np.arange(len(gold))
        right = unary[places, gold].sum() + pair[gold[:-1], gold[1:]].sum()
        scores = unary
        if self.costs:
            scores = unary + 0.5
            scores[places, gold] = unary[places, gold] - 0.5
        if self.guess == "marginals":
            node, edge, logz = sequence_marginals(scores, pair)
            return node, edge, logz + (0.5 * n if self.costs else 0.0) - right
        tags, best = viterbi(scores, pair)
        node = np.zeros(unary.shape)
        node[places, tags] = 1
        return node, self._pairs(np.array(tags)), best + (0.5 * n if self.costs else 0.0) - right

    def update(self, ids: np.ndarray, counts: np.ndarray, gold: np.ndarray) -> float:
        """One step on a sentence, whose features' rows come token after token, counts a token; returns the loss."""
        of = np.repeat(np.arange(len(gold)), counts)
        if counts.all():
            unary = np.add.reduceat(self.w.take(ids, 0), counts.cumsum() - counts, axis=0)
        else:
            unary = np.zeros((len(gold), self.k))
            np.add.at(unary, of, self.w[ids])
        node, edge, loss = self.guessed(unary * self.scale, self.pair * self.scale, gold)
        node, edge = -node, -edge
        node[np.arange(len(gold)), gold] += 1
        edge += self._pairs(gold)
        eta = 1.0
        if self.step == "sgd":
            eta = self.rate * self.schedule(self.t, self.sentences)
            if eta * self.decay >= 1:
                raise ValueError("the rate times the decay must stay below 1")
            self.scale *= 1 - eta * self.decay
            if self.scale < 1e-9:
                self.w, self.pair, self.scale = self.w * self.scale, self.pair * self.scale, 1.0
        self.t += 1
        wrong = node.any(1)  # features of right guesses keep their weights
        if not wrong.all():
            if not wrong.any():  # then no pair of neighbours is wrong
                return max(float(loss), 0.0)
            some = wrong[of]
            ids, of = ids[some], of[some]
        if self.step == "mira":
            order = ids.argsort()
            rows = ids[order]
            first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1])) if len(rows) else np.zeros(0, np.int64)
            delta = np.add.reduceat(node[of[order]], first, axis=0) if len(rows) else np.zeros((0, self.k))
            norm = float((delta**2).sum() + (edge**2).sum())
            eta = min(self.c, loss / norm) if norm > 1e-9 and loss > 1e-9 else 0.0
            if not eta:
                return max(float(loss), 0.0)
        at, parts = (ids[:, None] * self.k + np.arange(self.k)).ravel(), (eta / self.scale * node).take(of, 0).ravel()
        np.add.at(self.w.reshape(-1), at, parts)
        self.pair += eta / self.scale * edge
        if self.step != "sgd":
            np.add.at(self.sums.reshape(-1), at, self.t * parts)
            self.pair_sum += self.t * eta * edge
        return max(float(loss), 0.0)

    def fit(self, sentences: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]], epochs: int = 3) -> list[float]:
        """Steps over all sentences, epoch after epoch; the sum of losses of each epoch."""
        rows = list(sentences)
        self.sentences = len(rows)
        return [sum(self.update(*r) for r in rows) for _ in range(epochs)]

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        """The model: averaged weights, or the last ones of gradient descent."""
        return self.w * self.scale - self.sums / (self.t + 1), self.pair * self.scale - self.pair_sum / (self.t + 1)


def packed_features(tokens: DataFrame, templates: list[tuple[str, list[str]]] = TAGGER, bits: int = BITS) -> DataFrame:
    """doc_id, sent_id, tok_ids, tags, counts (features of each token), ids (their rows, flat): a row a sentence."""
    ids = F.transform(compiled(templates), lambda f: F.pmod(F.xxhash64(f), F.lit(1 << bits)).cast("int"))
    toks = F.array_sort(F.collect_list(F.struct("tok_id", "tag", ids.alias("ids"))))
    rows = with_parts(tokens).groupBy(*SENT).agg(toks.alias("toks"))
    return rows.select(*SENT, F.col("toks.tok_id").alias("tok_ids"), F.col("toks.tag").alias("tags"), F.transform("toks", lambda x: F.size(x["ids"])).alias("counts"), F.flatten("toks.ids").alias("ids"))


def _sentences(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """ids and counts of each row."""
    flat = [(b.column(c).offsets.to_numpy(), b.column(c).values.to_numpy()) for c in ("ids", "counts")]
    for i in range(b.num_rows):
        yield tuple(v[o[i] : o[i + 1]] for o, v in flat)


def _packed_sentences(b: pa.RecordBatch, labels: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """ids, counts and gold labels of each row of `packed_features`."""
    tags = b.column("tags")
    gold, at = pc.index_in(tags.values, pa.array(labels)), tags.offsets.to_numpy()
    if gold.null_count:
        raise ValueError("a tag isn't among the labels")
    gold = gold.to_numpy()
    for i, (ids, counts) in enumerate(_sentences(b)):
        yield ids, counts, gold[at[i] : at[i + 1]]


#: Up to so many learners work in step in one task.
TOGETHER = 8


def trained_by_mixing(packed: DataFrame, labels: list[str], rounds: int = 2, learners: int | None = None, bits: int = BITS, read: Callable | None = None, **how) -> tuple[np.ndarray, np.ndarray]:
    """Iterative parameter mixing: each of a fixed number of learners starts from the common weights and sees its sentences in
    order; Spark averages what they give. how: of SequenceLearner. Reruns agree but for the order of sums.
    read: gives ids, gold labels and offsets of a batch's sentences, and each one's row in the batch; then learners that outnumber
    the cores share tasks, where they work in step. Without it rows are those of `packed_features`."""
    from glossa.operators.lockstep import Lockstep

    spark, k = packed.sparkSession, len(labels)
    parts = learners or int(spark.conf.get("spark.sql.shuffle.partitions"))
    if read:
        each = min(TOGETHER, -(-parts // spark.sparkContext.defaultParallelism))
        tasks = -(-parts // each)
        rows = packed.withColumn("learner", F.pmod(F.hash(*SENT), F.lit(parts))).repartitionById(tasks, F.col("learner") % tasks).sortWithinPartitions(*SENT)
    else:
        rows = packed.repartition(parts, *SENT).sortWithinPartitions(*SENT)
    weights, pair = np.zeros((1 << bits, k)), np.zeros((k, k))
    for _ in range(rounds):
        start = spark.sparkContext.broadcast((weights, pair))

        def run(batches: Iterator[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:
            if read:
                together = Lockstep(each, k, bits=bits, **how)
                together.start(*start.value)
                for b in batches:
                    who = b.column("learner").to_numpy() // tasks
                    for ids, gold, offset, row in read(b):
                        together.fit(ids, gold, offset, who[row])
                own, own_pair, n = together.totals()
            else:
                learner = SequenceLearner(k, bits=bits, **how)
                learner.w, learner.pair = (x.copy() for x in start.value)
                for b in batches:
                    for ids, counts, gold in _packed_sentences(b, labels):
                        if len(counts):
                            learner.update(ids, counts, gold)
                n, (own, own_pair) = int(learner.t > 0), learner.result()
            if n:
                used = np.flatnonzero(own.any(1))
                out = np.concatenate([own[used], own_pair, np.full((1, k), n)])
                names = np.concatenate([used, -2 - np.arange(k), [-1]])
                for a in range(0, len(out), 10_000):
                    some = out[a : a + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array(names[a : a + 10_000], pa.int32()), *[pa.array(some[:, j]) for j in range(k)]], names=["row", *[f"w{j}" for j in range(k)]])

        found = rows.mapInArrow(run, ", ".join(["row int", *[f"w{j} double" for j in range(k)]]))
        sums = found.groupBy("row").agg(*[F.sum(f"w{j}").alias(f"w{j}") for j in range(k)]).toArrow()  # at most 2^bits rows and k + 1
        row, values = sums["row"].to_numpy(), np.stack([sums[f"w{j}"].to_numpy() for j in range(k)], 1)
        start.destroy()
        if not len(row):
            return weights, pair
        values = values / values[row == -1][0]
        weights = np.zeros_like(weights)
        weights[row[row >= 0]] = values[row >= 0]
        pair = values[row < -1][np.argsort(-row[row < -1])]
    return weights, pair


def tagged(packed: DataFrame, labels: list[str], weights: np.ndarray, pair: np.ndarray) -> DataFrame:
    """doc_id, sent_id, tok_id, tag, predicted by Viterbi; the model is sent once."""
    model = packed.sparkSession.sparkContext.broadcast((weights, pair))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, p = model.value
        for b in batches:
            out = []
            for ids, counts in _sentences(b):
                unary = np.zeros((len(counts), len(labels)))
                np.add.at(unary, np.repeat(np.arange(len(counts)), counts), w[ids])
                out.append([labels[i] for i in viterbi(unary, p)[0]] if len(counts) else [])
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in (*SENT, "tok_ids", "tags")], pa.array(out, pa.list_(pa.string()))], names=[*SENT, "tok_ids", "tags", "predicted"])

    types = {f.name: f.dataType.simpleString() for f in packed.schema}
    out = packed.select(*SENT, "tok_ids", "tags", "counts", "ids").mapInArrow(run, ", ".join([*[f"{c} {types[c]}" for c in (*SENT, "tok_ids", "tags")], "predicted array<string>"]))
    return out.select(*SENT, F.explode(F.arrays_zip("tok_ids", "tags", "predicted")).alias("z")).select(*SENT, F.col("z.tok_ids").alias("tok_id"), F.col("z.tags").alias("tag"), "z.predicted")
