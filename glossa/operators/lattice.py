"""Tagging over lattices: each token has the labels that a dictionary allows it, and neighbours the pairs that a scheme allows.

Steps are taken over the allowed labels of two neighbours only, so time goes with the lattice, not with the square of the label set.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.operators.corpus import SENT, START, STOP, allowed_bigrams
from glossa.operators.decode import viterbi


def legal_pairs(labels: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which labels may follow which, which may begin and which may end, as 0 and -inf, by the scheme (IO, BIO or BILOU) of the labels."""
    place = {x: i for i, x in enumerate(labels)}
    pair, first, last = np.full((len(labels),) * 2, -np.inf), np.full(len(labels), -np.inf), np.full(len(labels), -np.inf)
    for left, right in allowed_bigrams(list(labels)):
        if left == START and right in place:
            first[place[right]] = 0
        elif right == STOP and left in place:
            last[place[left]] = 0
        elif left in place and right in place:
            pair[place[left], place[right]] = 0
    return pair, first, last


def best_path(unary: np.ndarray, pair: np.ndarray, allowed: Sequence[np.ndarray]) -> list[int] | None:
    """The best labels of a sequence among those allowed at each place, by unary[n, k] and pair[k, k]; None if no path is legal.

    Of equal paths the one whose last different label is the smaller.
    """
    score, back = unary[0][allowed[0]], []
    for i in range(1, len(allowed)):
        steps = score[:, None] + pair[np.ix_(allowed[i - 1], allowed[i])]
        back.append(steps.argmax(0))
        score = steps.max(0) + unary[i][allowed[i]]
    if not len(score) or not np.isfinite(score.max()):
        return None
    at = int(score.argmax())
    out = [int(allowed[-1][at])]
    for i in range(len(allowed) - 2, -1, -1):
        at = int(back[i][at])
        out.append(int(allowed[i][at]))
    return out[::-1]


def seen_labels(tokens: DataFrame, key: str, label: str) -> DataFrame:
    """key, allowed: the labels that each value of a column has had (a word, a coarse tag), in order."""
    return tokens.groupBy(key).agg(F.array_sort(F.collect_set(label)).alias("allowed"))


def with_lattice(packed: DataFrame, tokens: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """packed (doc_id, sent_id, ...) with allowed: an array of arrays of labels, empty where the key hasn't been seen."""
    each = tokens.select(*SENT, "tok_id", key).join(seen, key, "left").select(*SENT, "tok_id", F.coalesce("allowed", F.array().cast("array<string>")).alias("allowed"))
    return packed.join(each.groupBy(*SENT).agg(F.array_sort(F.collect_list(F.struct("tok_id", "allowed"))).alias("t")).select(*SENT, F.col("t.allowed").alias("allowed")), SENT)


def tagged(packed: DataFrame, labels: Sequence[str], weights: np.ndarray, pair: np.ndarray) -> DataFrame:
    """doc_id, sent_id, tok_id, predicted: as `learn.tagged`, within each token's lattice and by legal pairs only.

    packed: of `learn.packed_features` and `with_lattice`. A token whose lattice is empty may have any label; a sentence whose lattice
    has no legal path is labelled by legal pairs alone.
    """
    model = packed.sparkSession.sparkContext.broadcast((weights, pair))
    names = pa.array(labels, pa.string())
    legal, first, last = legal_pairs(labels)
    every = np.arange(len(labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, p = model.value
        p = p + legal
        for b in batches:
            flat = {c: (b.column(c).offsets.to_numpy(), b.column(c).values) for c in ("ids", "counts", "allowed")}
            out = []
            for i in range(b.num_rows):
                ids, counts = (flat[c][1][flat[c][0][i] : flat[c][0][i + 1]].to_numpy() for c in ("ids", "counts"))
                unary = np.zeros((len(counts), len(labels)))
                np.add.at(unary, np.repeat(np.arange(len(counts)), counts), w[ids])
                unary[0] += first
                unary[-1] += last
                lists = flat["allowed"][1][flat["allowed"][0][i] : flat["allowed"][0][i + 1]]
                codes, at = pc.index_in(lists.flatten(), names), np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy()))
                codes = codes.fill_null(-1).to_numpy()
                rows = [r[r >= 0] for r in (codes[x:z] for x, z in zip(at[:-1], at[1:], strict=True))]
                path = best_path(unary, p, [np.sort(r) if len(r) else every for r in rows])
                out.append([labels[x] for x in (path if path is not None else viterbi(unary, p)[0])])
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in (*SENT, "tok_ids")], pa.array(out, pa.list_(pa.string()))], names=[*SENT, "tok_ids", "predicted"])

    types = {f.name: f.dataType.simpleString() for f in packed.schema}
    schema = ", ".join([*[f"{c} {types[c]}" for c in (*SENT, "tok_ids")], "predicted array<string>"])
    out = packed.select(*SENT, "tok_ids", "counts", "ids", "allowed").mapInArrow(run, schema)
    return out.select(*SENT, F.explode(F.arrays_zip("tok_ids", "predicted")).alias("z")).select(*SENT, F.col("z.tok_ids").alias("tok_id"), "z.predicted")
